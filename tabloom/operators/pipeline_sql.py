"""SQL scripts made ready to run: comments out, variables in, batches apart."""

from __future__ import annotations

import re
from dataclasses import dataclass

from tabloom.sources.paths import read_lines_utf8


def remove_sql_comments(code: str, literals: bool = True) -> str:
    """Without -- and /* */ (nested) comments; line ends stay, so that line numbers hold.

    What opens first wins; an open comment runs to the end. With ``literals``,
    signs inside quoted text open nothing.
    """
    out, i, depth, line, quoted = [], 0, 0, False, None
    while i < len(code):
        two, c = code[i : i + 2], code[i]
        if c == "\n":
            line = False
            out.append(c)
        elif line:
            pass
        elif depth:
            if two in ("/*", "*/"):
                depth += 1 if two == "/*" else -1
                i += 1
        elif quoted:
            out.append(c)
            quoted = None if c == quoted else quoted
        elif two == "--":
            line = True
            i += 1
        elif two == "/*":
            depth = 1
            i += 1
        else:
            quoted = c if literals and c in "'\"" else None
            out.append(c)
        i += 1
    return "".join(out)


def sql_cmd_mode_fix(code: str, most: int = 100) -> str:
    """Lines ``:setvar name value`` go (the line end stays) and $(name) becomes the value."""
    found = {}

    def keep(m: re.Match) -> str:
        found[m[1]] = m[2].strip()
        return ""

    code = re.sub(r"(?mi)^[ \t]*:setvar[ \t]+(\S+)[ \t]+(.*?)[ \t]*$", keep, code)
    if len(found) > most:
        raise ValueError(f"more than {most} variables")
    for name, value in found.items():
        code = code.replace(f"$({name})", value)
    return code


@dataclass(frozen=True)
class Batch:
    code: str
    start_line: int
    end_line: int


def split_batches(code: str) -> list[Batch]:
    """At semicolons outside of text in quotes, and at lines of GO; a batch starts on the line where the last one ended."""
    out, start, quoted, line, pieces = [], 0, False, 1, []
    for m in re.finditer(r"'|;|(?<=\n)[ \t\r\f\v]*[gG][oO][ \t\r\f\v]*(?=\n)", code):
        if m[0] == "'":
            quoted = not quoted
        elif not quoted:
            pieces.append(code[start : m.start()])
            start = m.end()
    if code[start:]:
        pieces.append(code[start:])
    for p in pieces:
        n = p.count("\n")
        out.append(Batch(p, line, line + n))
        line += n
    return out


def read_and_prepare_sql_code(path: str, inject: dict[str, str] | None = None, literals: bool = True) -> list[Batch]:
    if not path.lower().endswith(".sql"):
        raise ValueError(f"not a .sql file: {path}")
    code = "\n".join([*read_lines_utf8(path), ""])
    code = sql_cmd_mode_fix(remove_sql_comments(code, literals))
    for name, value in (inject or {}).items():
        code = code.replace(name, value)
    return split_batches(code)
