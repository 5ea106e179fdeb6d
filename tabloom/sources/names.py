"""Column names as the control files' readers make them."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame

#: Words that can't be names by themselves.
RESERVED = {"if", "else", "repeat", "while", "function", "for", "next", "break", "TRUE", "FALSE", "NULL", "Inf", "NaN", "NA", "in"}


def make_name(text: str) -> str:
    """Characters other than letters, digits, dots and underscores become dots."""
    out = re.sub(r"[^\w.]", ".", text, flags=re.UNICODE)
    if not out or not (out[0].isalpha() or out[0] == ".") or re.match(r"\.\d", out):
        out = "X" + out
    return out + "." if out in RESERVED else out


def make_unique(names: Iterable[str]) -> list[str]:
    """Later copies get .1, .2, ... that no other name has."""
    names, taken, out, count = list(names), set(), [], {}
    taken = set(names)
    seen = set()
    for name in names:
        if name not in seen:
            seen.add(name)
            out.append(name)
            continue
        n = count.get(name, 0) + 1
        while f"{name}.{n}" in taken:
            n += 1
        count[name] = n
        taken.add(f"{name}.{n}")
        out.append(f"{name}.{n}")
    return out


def make_names(names: Sequence[str]) -> list[str]:
    return make_unique([make_name(n) for n in names])


def tolower_colnames(df: DataFrame) -> DataFrame:
    lower = [c.lower() for c in df.columns]
    if len(set(lower)) < len(lower):
        raise ValueError("column names are not unique without case")
    return df.toDF(*lower)


def sql2id(text: str) -> list[str]:
    """Parts of a name like [db].[schema].[table]."""
    return [p.strip().strip("[]").strip() for p in re.findall(r"\[[^\]]*\]|[^.]+", text)]


def spare(names: Iterable[str], *wanted: str) -> list[str]:
    """The wanted names with a mark before them that makes them unlike all the others, in any case."""
    have = {n.lower() for n in names}
    mark = "_"
    while any(f"{mark}{w}".lower() in have for w in wanted):
        mark += "_"
    return [mark + w for w in wanted]
