"""Summary rows that share one scan.

Each row of a control file is a query of its own, and stacked they scan the table
once for each. Rows whose aggregates are sums, counts, least or greatest values
can share: the table is aggregated once by all of their group columns together,
each filter being a condition inside its own aggregates, and that smaller table is
aggregated again by each row's columns, as grouping sets. A projection then makes
each group the output of the rows that asked for it.

That pays where the group columns together have far fewer combinations than the
table has rows; where they have not, ``sets`` skips the first step, or the rows
are better left apart. Distinct counts, standard deviations and entities of two
columns are always left apart.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Aggregates that can be made of parts, with how parts are put together.
PARTS: dict[str, tuple[Callable, Callable]] = {
    "count": (F.count, F.sum),
    "sum": (F.sum, F.sum),
    "seed": (lambda x: F.sum(F.pmod(x, F.lit(100))), F.sum),
    "min": (F.min, F.min),
    "max": (F.max, F.max),
}
MODES = ("apart", "rollup", "sets")


@dataclass
class SharedRow:
    """What a control row asks: group columns, filter, aggregates (header to kind, text and value), and its output of a group.

    Filters and values of the same text are the same, and are aggregated once.
    """

    groups: list[str]
    filter: str
    where: Column | None
    aggregates: dict[str, tuple[str, str, Column]]
    #: from columns of groups (by name) and of aggregates (by header) to the output's fields
    output: Callable[[dict[str, Column], dict[str, Column]], list[Column]]


def shared(df: DataFrame, rows: Sequence[SharedRow], mode: str, remove_na: bool) -> DataFrame:
    """The outputs of all rows, from one scan."""
    names = list(dict.fromkeys(g for r in rows for g in r.groups))
    keys = {g: f"g{i}" for i, g in enumerate(names)}
    own, parts, merge, made = [], [], [], {}
    one_filter = len({r.filter for r in rows}) == 1
    columns = []  # of each row: its count of rows, and its aggregates
    for r in rows:
        held = (lambda c, w=r.where: c if w is None or one_filter else F.when(w, c))
        mine = []
        for kind, text, value in [("count", "", F.lit(1)), *r.aggregates.values()]:
            key = (r.filter, kind, text)
            if key not in made:
                first, again = PARTS[kind]
                made[key] = column = f"a{len(made)}"
                own.append(held(value).alias(column))
                parts.append(first(column).alias(column))
                merge.append((first if mode == "sets" else again)(column).alias(column))
            mine.append(made[key])
        columns.append(mine)
    wheres = [r.where for r in rows]
    if all(w is not None for w in wheres):  # rows that no filter takes are of no use
        df = df.where(wheres[0] if one_filter else reduce(lambda a, b: a | b, wheres))
    narrow = df.select(*(F.col(f"`{g}`").alias(k) for g, k in keys.items()), *own)
    base = narrow if mode == "sets" else narrow.groupBy(*keys.values()).agg(*parts)

    def output(i: int, row: SharedRow) -> Column:
        return F.struct(*row.output({g: F.col(keys[g]) for g in row.groups}, {h: F.col(c) for h, c in zip(row.aggregates, columns[i][1:], strict=True)}))

    frames = []
    grouped = [(i, r) for i, r in enumerate(rows) if r.groups]
    if grouped:
        sets = list(dict.fromkeys(tuple(sorted({keys[g] for g in r.groups})) for _, r in grouped))
        found = base.groupingSets([list(s) for s in sets], *keys.values()).agg(*merge, F.grouping_id().alias("set"))
        outs = []
        for i, r in grouped:
            mine = {keys[g] for g in r.groups}
            number = sum(1 << (len(keys) - 1 - at) for at, k in enumerate(keys.values()) if k not in mine)
            there = (F.col("set") == number) & (F.col(columns[i][0]) > 0)
            if remove_na:
                there = reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in sorted(mine)), there)
            outs.append(F.when(there, output(i, r)))
        frames.append(found.select(F.inline(F.array_compact(F.array(*outs)))))
    if len(grouped) < len(rows):  # of the whole table there is always one output
        frames.append(base.agg(*merge).select(F.inline(F.array(*(output(i, r) for i, r in enumerate(rows) if not r.groups)))))
    return reduce(DataFrame.unionByName, frames)
