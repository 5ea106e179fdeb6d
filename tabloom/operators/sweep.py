"""Overlap summaries without pairs, for uids with very many events.

A period meets every event of its uid in the plain join, so the work for one uid
is its events times its periods. Here times are whole numbers (days, or
microseconds), and the number line is a binary tree of blocks: a block of level k
is 2^k long. The events that overlap a period from ps to pe are, each once,

* those that start in it, and
* those that last from ps - 1 to ps, that is, over the gap before it.

A period is at most two blocks of each level, and a start lies in one block of
each, so the first kind meets by block. An event covers at most two blocks of
gaps of each level, and a gap lies in one of each, so the second kind meets by
block too. Blocks are summed before they meet, so what moves grows with events and
periods, times the levels, and is keyed by (uid, level, block): a uid with a third
of all events is no task's alone. Nothing is subtracted that other events were
added to, so sums of doubles are as good as those of pairs.

Days inside a period, for DURATION and SUM_WITHIN, are min(pe, me) + 1 - max(ps, ms):
events that end in the period give their own end, those that last over the gap
after it give pe, and likewise for starts.

Events or periods that end before they begin do not fit the tree; they meet in
pairs as before.

DISTINCT is a sum over steps. An event overlaps a period if it starts by pe and
ends from ps on. Of one uid's events with one value, those are kept that end later
than all that start before them; sorted by start, they are sorted by end too, so
those that overlap a period follow one another, and counting each, less each
neighbouring pair of which both overlap, gives one for the value. Both of a pair
overlap a period if it holds from the later start to the earlier end, so a pair is
an event to be subtracted: one that fits the tree, or one that ends before it
begins, which overlaps the periods that it lies in. Steps are summed by start and end
over all values (whole numbers, so sums are exact), and those that lie in periods
meet by the block of their first time, which tells all but their last.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.sources.work import stored

#: Methods that are sums, least or greatest values over events, or over steps of events.
SWEPT = ("MIN", "MAX", "EXISTS", "COUNT", "MEAN", "SUM", "SUM_WITHIN", "DURATION", "DISTINCT")
#: Uids with very many events that may be broadcast.
MOST_HOT = 100_000
_WITHIN = ("SUM_WITHIN", "DURATION")


def hot_uids(events: DataFrame, least: int) -> DataFrame:
    """muid of more than ``least`` events, stored."""
    counted = events.where("muid is not null").groupBy("muid").agg(F.count("*").alias("n")).where(F.col("n") > least)
    return stored(counted.select("muid"), "hot-uids")


def split(df: DataFrame, column: str, hot: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of hot uids and the others; the hot ones are broadcast while they are few."""
    held = hot.withColumnRenamed("muid", "hot_uid")
    held = F.broadcast(held) if hot.limit(MOST_HOT + 1).count() <= MOST_HOT else held
    same = F.col(column).cast("string") == F.col("hot_uid").cast("string")
    if dict(df.dtypes)[column] == dict(hot.dtypes)["muid"]:
        same = F.col(column) == F.col("hot_uid")
    return df.join(held, same, "left_semi"), df.join(held, same, "left_anti")


def _number(c: str, kind: str) -> Column:
    return (F.unix_micros(c) if kind == "timestamp" else F.unix_date(c)).cast("long")


def _levels(longest: int | None) -> int:
    """The highest level of a block within a run of this length."""
    return max(int(longest or 1), 1).bit_length() - 1


def _blocks_of(first: Column, last: Column) -> Column:
    """The blocks of column ``level`` that belong to the run from first to last: at most one at each end."""
    size = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("level"))
    a = F.call_function("shiftright", first + size - 1, F.col("level"))
    b = F.call_function("shiftright", last + 1, F.col("level"))
    odd = lambda c: c.bitwiseAND(F.lit(1).cast("long")) == 1
    both = F.array(F.when((a < b) & odd(a), a), F.when((a < b) & odd(b), b - 1))
    return F.explode(F.array_compact(both))


def _all_levels(top: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(top)))


def _block_at(point: Column) -> Column:
    return F.call_function("shiftright", point, F.col("level"))


class _Row:
    """The pieces of one output: over an event (or block) and over a match."""

    def __init__(self, i: int, method: str):
        self.i, self.method, self.v = i, method.strip().upper(), F.col(f"v{i}")
        self.own, self.n, self.t, self.w = f"own{i}", f"n{i}", f"t{i}", f"w{i}"
        self.within = self.method in _WITHIN

    def weight(self) -> Column:
        if self.method == "DURATION":
            return F.when(self.v.isNotNull(), F.lit(1).cast("long"))
        return self.v.cast("double") / F.col("days")

    def count(self) -> Column:
        return (F.sum(self.v) if self.method == "DISTINCT" else F.count(self.v)).alias(self.n)

    def starts(self) -> list[Column]:
        """Of events that start in a block."""
        if self.within:
            return [F.count(self.v).alias(self.n), F.sum(-self.weight() * F.col("first_day")).alias(self.t)]
        return [self.count(), *self._own()]

    def ends(self) -> list[Column]:
        return [F.sum(self.weight() * (F.col("last_day") + 1)).alias(self.t)] if self.within else []

    def gaps(self) -> list[Column]:
        """Of events that last over a block of gaps."""
        if self.within:
            return [F.count(self.v).alias(self.n), F.sum(self.weight()).alias(self.w)]
        return [self.count(), *self._own()]

    def pairs(self) -> list[Column]:
        overlap = F.datediff(F.least("pe", "me"), F.greatest("ps", "ms")) + 1
        if self.within:
            share = F.when(self.v.isNotNull(), overlap) if self.method == "DURATION" else overlap.cast("double") / F.nullif(F.col("days"), F.lit(0)) * self.v
            return [F.count(share).alias(self.n), F.sum(share).alias(self.t)]
        return [self.count(), *self._own()]

    def _own(self) -> list[Column]:
        fn = {"MIN": F.min, "MAX": F.max, "SUM": F.sum, "MEAN": F.sum}.get(self.method)
        return [fn(self.v).alias(self.own)] if fn else []

    def again(self) -> list[Column]:
        """Sums of sums, for blocks of blocks and for all matches."""
        fn = {"MIN": F.min, "MAX": F.max}.get(self.method, F.sum)
        own = [fn(self.own).alias(self.own)] if self.method in ("MIN", "MAX", "SUM", "MEAN") else []
        return [F.sum(self.n).alias(self.n), *own, *([F.sum(self.t).alias(self.t)] if self.within else [])]

    def total(self) -> Column:
        n = F.coalesce(self.n, F.lit(0).cast("long"))
        if self.within:
            return F.when(n > 0, F.col(self.t))
        if self.method in ("COUNT", "DISTINCT"):
            return n
        if self.method == "EXISTS":
            return F.when(n >= 1, F.lit(1))
        return F.try_divide(self.own, self.n) if self.method == "MEAN" else F.col(self.own)


def swept(keys: DataFrame, events: DataFrame, methods: Mapping[int, str], kind: str) -> DataFrame:
    """uid, ps, pe and out0, out1, ... of each period that events overlap, by the numbers of the methods.

    ``keys``: distinct uid, ps, pe; ``events``: muid, ms, me, v0, v1, ...; times of
    type ``kind``. Both are stored, as several blocks are made of each.
    """
    rows = [_Row(i, m) for i, m in methods.items()]
    asked = keys.where("uid is not null and ps is not null and pe is not null")
    asked = stored(asked.withColumns({"p": _number("ps", kind), "q": _number("pe", kind)}), "sweep-periods")
    r = asked.where("p <= q").agg(F.max(F.col("q") - F.col("p")) + 1, F.min(F.unix_date(F.to_date("ps")))).first()
    longest, origin = r[0], r[1] or 0
    # small numbers of days, as they are factors of what is added
    day = lambda c: F.unix_date(F.to_date(c)).cast("long") - origin
    matches = []
    if sums := [x for x in rows if x.method != "DISTINCT"]:
        timed = events.where("muid is not null and ms is not null and me is not null").withColumns(
            {"a": _number("ms", kind), "b": _number("me", kind), "first_day": day("ms"), "last_day": day("me"), "days": F.datediff("me", "ms") + 1}
        )
        timed = stored(timed, "sweep-events")
        matches += _by_blocks(asked, timed, sums, longest, day)
        for k, e in ((asked, timed.where("a > b")), (asked.where("p > q"), timed.where("a <= b"))):
            pairs = k.join(e, _same(k, e) & (F.col("ps") <= F.col("me")) & (F.col("ms") <= F.col("pe")))
            matches.append(pairs.groupBy("uid", "ps", "pe").agg(*(c for x in sums for c in x.pairs())))
    for x in rows:
        if x.method == "DISTINCT":
            steps = stored(_steps(events, x, kind), "sweep-steps")
            matches += _by_blocks(asked, steps, [x], longest, day)
            matches.append(_lying_in(asked, steps.where("a > b"), longest).groupBy("uid", "ps", "pe").agg(*x.pairs()))
            matches.append(_paired(asked.where("p > q"), steps, x))
    every = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), matches)
    return every.groupBy("uid", "ps", "pe").agg(*(c for x in rows for c in x.again())).select("uid", "ps", "pe", *(x.total().alias(f"out{x.i}") for x in rows))


def stepped(keys: DataFrame, events: DataFrame, i: int, kind: str) -> DataFrame:
    """uid, ps, pe and the count of distinct values, by pairs of periods and steps: sums have a group for each period, not for each pair."""
    row = _Row(i, "DISTINCT")
    asked = keys.withColumns({"p": _number("ps", kind), "q": _number("pe", kind)})
    return _paired(asked, _steps(events, row, kind), row).select("uid", "ps", "pe", row.total().alias(f"out{i}"))


def _paired(asked: DataFrame, steps: DataFrame, row: _Row) -> DataFrame:
    pairs = asked.join(steps, _same(asked, steps) & (F.col("p") <= F.col("b")) & (F.col("a") <= F.col("q")))
    return pairs.groupBy("uid", "ps", "pe").agg(*row.pairs())


def _steps(events: DataFrame, row: _Row, kind: str) -> DataFrame:
    """muid, a, b and the row's value: how often to count what starts at a and ends at b, less how often not to.

    A missing value counts nothing, but its events overlap periods all the same. Of
    one uid and value what moves are its distinct starts, each with its latest end.
    """
    known = events.where("muid is not null and ms is not null and me is not null")
    seen = known.select("muid", row.v.alias("v"), _number("ms", kind).alias("a"), _number("me", kind).alias("b")).groupBy("muid", "v", "a").agg(F.max("b").alias("b"))
    before = Window.partitionBy("muid", "v").orderBy("a").rowsBetween(Window.unboundedPreceding, -1)
    kept = seen.withColumn("last", F.max("b").over(before)).where("last is null or b > last")
    one = F.when(F.col("v").isNull(), F.lit(0)).otherwise(F.lit(1)).cast("long")
    step = lambda b, n: F.struct("a", F.col(b).alias("b"), n.alias("n"))
    both = F.array_compact(F.array(step("b", one), F.when(F.col("last").isNotNull(), step("last", -one))))
    return kept.select("muid", F.explode(both).alias("step")).groupBy("muid", "step.a", "step.b").agg(F.sum("step.n").alias(f"v{row.i}"))


def _lying_in(asked: DataFrame, steps: DataFrame, longest: int | None) -> DataFrame:
    """Ordered periods with the steps from b up to a that lie in them; a step that is longer than every period lies in none."""
    top = _levels(longest)
    held = steps.where(F.col("a") - F.col("b") < F.lit(longest or 0)).withColumn("level", _all_levels(top)).withColumn("block", _block_at(F.col("b")))
    want = asked.where("p <= q").withColumn("level", _all_levels(top)).withColumn("block", _blocks_of(F.col("p"), F.col("q")))
    return _meet(want, held).where("a <= q")


def _by_blocks(asked: DataFrame, timed: DataFrame, rows: list[_Row], longest: int | None, day) -> list[DataFrame]:
    """What ordered periods get from events that do not end before they begin."""
    proper, ordered = timed.where("a <= b"), asked.where("p <= q")
    lasting = proper.agg(F.max(F.col("b") - F.col("a"))).first()[0]
    top, gap_top = _levels(longest), _levels(lasting)

    def block(df: DataFrame, by: str, columns: list[Column]) -> DataFrame:
        """Summed by time first, as many events share a day, then by block of every level."""
        few = df.groupBy("muid", by).agg(*columns)
        return few.withColumn("level", _all_levels(top)).withColumn("block", _block_at(F.col(by))).drop(by)

    parts = [block(proper, "a", [c for r in rows for c in r.starts()])]
    if any(r.within for r in rows):
        parts.append(block(proper, "b", [c for r in rows for c in r.ends()]))
    sums = [c for r in rows for c in r.again()]
    inside = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts).groupBy("muid", "level", "block").agg(*sums)
    want = ordered.withColumn("level", _all_levels(top)).withColumn("block", _blocks_of(F.col("p"), F.col("q")))
    met = _meet(want, inside).drop("p", "q")

    matches = [met]
    if lasting:
        few = proper.where("b > a").groupBy("muid", "a", "b").agg(*(c for r in rows for c in r.gaps()))
        spread = few.withColumn("level", _all_levels(gap_top)).withColumn("block", _blocks_of(F.col("a"), F.col("b") - 1)).drop("a", "b")
        again = [c for r in rows for c in (*[x for x in r.again() if not r.within], *([F.sum(r.n).alias(r.n), F.sum(r.w).alias(r.w)] if r.within else []))]
        gaps = spread.groupBy("muid", "level", "block").agg(*again)
        sides = [(F.lit(0), F.col("p") - 1)] + ([(F.lit(1), F.col("q"))] if any(r.within for r in rows) else [])
        points = ordered.withColumn("side", F.explode(F.array(*(F.struct(s.alias("after"), g.alias("gap")) for s, g in sides))))
        points = points.select("uid", "ps", "pe", "side.*").withColumn("level", _all_levels(gap_top)).withColumn("block", _block_at(F.col("gap")))
        over = _meet(points, gaps)
        columns = []
        for r in rows:
            before = lambda c: F.when(F.col("after") == 0, F.col(c)).alias(c)
            columns.append(before(r.n))
            if r.within:
                columns.append((F.when(F.col("after") == 0, -day("ps")).otherwise(day("pe") + 1) * F.col(r.w)).alias(r.t))
            elif r.method in ("MIN", "MAX", "SUM", "MEAN"):
                columns.append(before(r.own))
        matches.append(over.select("uid", "ps", "pe", *columns))
    return matches


def _same(keys: DataFrame, events: DataFrame) -> Column:
    kinds = dict(keys.dtypes)["uid"], dict(events.dtypes)["muid"]
    if "string" in kinds and kinds[0] != kinds[1]:
        return F.col("uid").cast("string") == F.col("muid").cast("string")
    return F.col("uid") == F.col("muid")


def _meet(asked: DataFrame, blocks: DataFrame) -> DataFrame:
    held = blocks.withColumnsRenamed({"level": "of_level", "block": "of_block"})
    on = _same(asked, held) & (F.col("level") == F.col("of_level")) & (F.col("block") == F.col("of_block"))
    return asked.join(held, on).drop("muid", "level", "block", "of_level", "of_block")
