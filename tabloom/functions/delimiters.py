"""Delimited cells: [column], "text", {expression}; and a guard against code that escapes its cell."""

from __future__ import annotations

from dataclasses import dataclass

PAIRS = {"[]": ("[", "]"), '"': ('"', '"'), "'": ("'", "'"), "{}": ("{", "}"), "()": ("(", ")")}


def _ends(delimiter: str) -> tuple[str, str]:
    for key, ends in PAIRS.items():
        if delimiter == key or delimiter in ends:
            return ends
    raise ValueError(f"no delimiter: {delimiter!r}")


def is_delimited(text: str | None, delimiter: str) -> bool:
    left, right = _ends(delimiter)
    text = (text or "").strip()
    return len(text) >= 2 and text[0] == left and text[-1] == right


def add_delimiters(text: str, delimiter: str) -> str:
    """Once only: delimited text stays as it is."""
    left, right = _ends(delimiter)
    return text if is_delimited(text, delimiter) else f"{left}{text}{right}"


def remove_delimiters(text: str, delimiter: str) -> str:
    text = text.strip()
    return text[1:-1].strip() if is_delimited(text, delimiter) else text


def no_obvious_escaping_injection(text: str) -> bool:
    """No statement ends or braces; quotes and brackets in pairs."""
    if any(c in text for c in ";{}"):
        return False
    if any(text.count(q) % 2 for q in "'\"`"):
        return False
    return text.count("(") == text.count(")") and text.count("[") == text.count("]")


@dataclass(frozen=True)
class Cell:
    """kind: column, constant or dynamic."""

    kind: str
    text: str


def read_cell(text: str, bare: str = "column") -> Cell:
    """What a cell holds; ``bare`` is the kind of text without delimiters."""
    text = text.strip()
    for delimiter, kind in (("{}", "dynamic"), ("[]", "column"), ('"', "constant"), ("'", "constant")):
        if is_delimited(text, delimiter):
            return Cell(kind, remove_delimiters(text, delimiter))
    return Cell(bare, text)
