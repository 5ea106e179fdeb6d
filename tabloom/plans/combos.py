"""Control rows from compact notation: combinations of groupings."""

from __future__ import annotations

import itertools
import re
from collections.abc import Sequence

from tabloom.sources.controlfile import ControlTable, keyword


def _within(names: Sequence[str | None]) -> list[str | None]:
    """A name that came before in the set counts as absent."""
    seen, out = set(), []
    for n in names:
        out.append(None if n in seen else n)
        seen.add(n)
    return out


def generate_combinations(*sets: Sequence[str | None], always: Sequence[str] = (), drop_dupes_within: bool = True, drop_dupes_across: bool = True) -> ControlTable:
    """One column of each set, with ``always`` first; None stands for "without".

    The first set varies fastest.
    """
    if not sets:
        raise ValueError("at least one set of names is needed")
    rows = []
    for combo in itertools.product(*reversed([list(s) for s in sets])):
        row = [*always, *reversed(combo)]
        rows.append(_within(row) if drop_dupes_within else row)
    if drop_dupes_across:
        seen, kept = set(), []
        for row in rows:
            key = tuple(sorted(n for n in row if n is not None))
            if key not in seen:
                seen.add(key)
                kept.append(row)
        rows = kept
    columns = [f"column{i}" for i in range(1, len(always) + len(sets) + 1)]
    return ControlTable(columns, [dict(zip(columns, r, strict=True)) for r in rows if any(n is not None for n in r)])


def cross_product_column_names(*sets: Sequence[str], always: Sequence[str] = (), drop_dupes_within: bool = True, drop_dupes_across: bool = True) -> list[list[str]]:
    """The same as lists, without the absent ones."""
    table = generate_combinations(*sets, always=always, drop_dupes_within=drop_dupes_within, drop_dupes_across=drop_dupes_across)
    return [[v for v in row.values() if v is not None] for row in table.rows]


def _alternatives(cell: str | None) -> list[str | None]:
    """a | b gives both; a last | + also gives none."""
    if cell is None:
        return [None]
    parts = [p.strip() for p in str(cell).split("|")]
    none = len(parts) > 1 and parts[-1] == "+"
    parts = [p for p in (parts[:-1] if none else parts) if p]
    return [*parts, *([None] if none else [])]


def _pattern(cell: str | None, names: Sequence[str], suffix: bool) -> list[str | None]:
    """prefix_* or *_suffix to the names it fits."""
    if cell is None:
        return [None]
    m = re.fullmatch(r"\[?\*(_.+?)\]?" if suffix else r"\[?(.+_)\*\]?", cell)
    if not m:
        return [cell]
    part = m[1].lower()
    found = [n for n in names if (n.lower().endswith(part) if suffix else n.lower().startswith(part))]
    if not found:
        raise ValueError(f"no column fits {cell}")
    return found


def expand_compact_summary_groups(control: ControlTable, column_names: Sequence[str], drop_dupes_within: bool = True, drop_dupes_across: bool = True, drop_no_group: bool = True) -> ControlTable:
    """One row for each grouping that a row's GROUP cells stand for.

    Columns are unfolded one after another, so the first varies slowest; the
    order of rows stays otherwise.
    """
    groups = [c for c in control.columns if keyword(c) == "group"]
    rows = [dict(r) for r in control.rows]
    steps = [_alternatives, lambda c: _pattern(c, column_names, False), lambda c: _pattern(c, column_names, True)]
    for step in steps:
        for g in groups:
            rows = [{**r, g: v} for r in rows for v in step(r[g])]
    if drop_dupes_within:
        rows = [{**r, **dict(zip(groups, _within([r[g] for g in groups]), strict=True))} for r in rows]
    if drop_dupes_across:
        seen, kept = set(), []
        for r in rows:
            key = (tuple(sorted(r[g] for g in groups if r[g] is not None)), tuple(str(r[c]) for c in control.columns if c not in groups))
            if key not in seen:
                seen.add(key)
                kept.append(r)
        rows = kept
    if drop_no_group:
        rows = [r for r in rows if not groups or any(r[g] is not None for g in groups)]
    return ControlTable(list(control.columns), rows)


def tolower_control_file_cells(control: ControlTable, kinds: Sequence[str], column_names: Sequence[str]) -> ControlTable:
    """Cells of columns of these kinds in lower case; inside braces only whole words that are column names."""
    known = {n.lower() for n in column_names}

    def inside(text: str) -> str:
        return re.sub(r"(?<![\w.])[^\W\d][\w.]*", lambda m: m[0].lower() if m[0].lower() in known else m[0], text)

    def lower(cell: str) -> str:
        return "".join(inside(p) if p.startswith("{") else p.lower() for p in re.findall(r"\{[^}]*\}?|[^{]+", cell))

    rows = [{c: lower(v) if isinstance(v, str) and keyword(c) in kinds else v for c, v in r.items()} for r in control.rows]
    return ControlTable(list(control.columns), rows)
