"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source is wanted the same fractional number of times. The
whole part is taken as copies; the fractions are rounded together so that the
source's words stay at the target: documents are paired, and words move at
random from one of a pair to the other until one fraction is 0 or 1. The other
goes on to the next pair. Chains of a bounded length leave one open document
each, and these are combined by further chains, level by level.

Only DataFrame functions are used. Randomness is a hash of the ids paired, so
reruns agree.

Of n rows equal in doc_id, text and source, each wanted f times, n * f are wanted:
the whole part of that is given to as many of them, by row number, and one row
carries what is left into the chains. Sources meet their rows by broadcast while
there are at most ``SOURCES`` of them, and else by a join with salted sources.

Defined results: a null text has size 0 and takes no part in the chains; a null
source is a source of its own, last in order; of rows equal in doc_id, text and
source (a null doc_id is one of its own) some may be taken once more than the others; a source without
words has target 0. All columns pass through; columns of the same names as the
added ones give way. Targets need one ordered pass over the sources, a row each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabloom.llm.common import Store, fresh

CAP = 3
WEIGHTS = (1, 2, 3)
#: Documents in a chain, about.
CHAIN = 64
#: Documents of more than so many times their source's mean size are rounded first.
LARGE = 4
#: Sources that may be broadcast, and parts that each is dealt to where there are more.
SOURCES, SALTS = 200_000, 64
_UNIT = "struct<k:bigint,d:bigint,s:double,f:double>"


def n_words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """source, source_size, target for frame (source, source_size).

    All sizes are shared by weight; a target stops at ``cap`` times its source's
    size and the excess goes to the others by weight. The sources at their caps
    are those with the least cap for their weight, so one ordered pass finds them.
    """
    every, rising = W.partitionBy(F.lit(1)), W.partitionBy(F.lit(1)).orderBy("ratio", "rank")
    falling = W.partitionBy(F.lit(1)).orderBy(F.desc("ratio"), F.desc("rank"))
    ranked = sizes.withColumn("rank", F.row_number().over(W.partitionBy(F.lit(1)).orderBy(F.asc_nulls_last("source"))))
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    at_cap = F.col("top") < F.col("total")
    return (
        ranked.withColumn("weight", weight.cast("double"))
        .withColumn("most", F.col("source_size").cast("double") * cap)
        .withColumn("ratio", F.col("most") / F.col("weight"))
        .withColumn("total", F.sum(F.col("source_size").cast("double")).over(every))
        # words if every share stopped at this source's ratio
        .withColumn("top", F.sum("most").over(rising) + F.col("ratio") * (F.sum("weight").over(falling) - F.col("weight")))
        .withColumn("fixed", F.coalesce(F.sum(F.when(at_cap, F.col("most"))).over(every), F.lit(0.0)))
        .withColumn("free", F.sum(F.when(~at_cap, F.col("weight"))).over(every))
        .withColumn("share", F.col("weight") * (F.col("total") - F.col("fixed")) / F.nullif(F.col("free"), F.lit(0.0)))
        .select("source", "source_size", F.when(at_cap, F.col("most")).otherwise(F.least("share", "most")).alias("target"))
    )


def _uniform(*parts: Column | str) -> Column:
    """In (0, 1), by hash."""
    return (F.pmod(F.xxhash64(*parts), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)


def _pivot(state: Column, unit: Column, seed: int) -> Column:
    """One pair: the carried document and the next one."""
    a, b = state["carry"], unit
    up = F.least((1 - a["f"]) * a["s"], b["f"] * b["s"])  # words that can move from b to a
    down = F.least(a["f"] * a["s"], (1 - b["f"]) * b["s"])
    rises = _uniform(a["k"], a["d"], b["k"], b["d"], F.lit(seed)) * (up + down) < down

    def keep(x: Column, f: Column) -> Column:
        return F.struct(x["k"].alias("k"), x["d"].alias("d"), x["s"].alias("s"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), f)).alias("f"))

    def done(x: Column, copies: int) -> Column:
        return F.struct(x["k"].alias("k"), x["d"].alias("d"), F.lit(copies).alias("up"))

    def step(carry: Column, ended: Column) -> Column:
        return F.struct(carry.alias("carry"), F.concat(state["done"], F.array(ended)).alias("done"))

    paired = (
        F.when(rises & (up == (1 - a["f"]) * a["s"]), step(keep(b, b["f"] - up / b["s"]), done(a, 1)))
        .when(rises, step(keep(a, a["f"] + up / a["s"]), done(b, 0)))
        .when(down == a["f"] * a["s"], step(keep(b, b["f"] + down / b["s"]), done(a, 0)))
        .otherwise(step(keep(a, a["f"] - down / a["s"]), done(b, 1)))
    )
    return F.when(a.isNull(), F.struct(b.alias("carry"), state["done"].alias("done"))).otherwise(paired)


def _chains(units: DataFrame, seed: int) -> DataFrame:
    """For each (source, bucket): the documents rounded, and the one left open."""
    start = F.struct(
        F.lit(None).cast(_UNIT).alias("carry"),
        F.array().cast("array<struct<k:bigint,d:bigint,up:int>>").alias("done"),
    )
    # by falling size: words move between documents of like size
    ordered = F.sort_array(F.collect_list(F.struct((-F.col("s")).alias("o"), "k", "d", "s", "f")))
    unit = F.transform(ordered, lambda u: F.struct(u["k"].alias("k"), u["d"].alias("d"), u["s"].alias("s"), u["f"].alias("f")))
    return (
        units.groupBy("source", "bucket")
        .agg(unit.alias("units"))
        .select("source", "bucket", F.aggregate("units", start, lambda s, u: _pivot(s, u, seed)).alias("r"))
        .select("source", "bucket", "r.carry", "r.done")
    )


def with_source(rows: DataFrame, held: DataFrame, left: bool = False, most: int = SOURCES) -> DataFrame:
    """Columns of ``held``, a stored row for each source, at each row of that source; a hot source meets its rows in many tasks."""
    how, same = "left" if left else "inner", F.col("source").eqNullSafe(F.col("of"))
    held = held.withColumnRenamed("source", "of")
    if held.limit(most + 1).count() <= most:
        return rows.join(F.broadcast(held), same, how).drop("of")
    dealt = held.withColumn("of_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("k", "d"), F.lit(SALTS)).cast("int"))
    return salted.join(dealt, same & (F.col("salt") == F.col("of_salt")), how).drop("of", "salt", "of_salt")


def round_together(units: DataFrame, store: Store, name: str, seed: int, chain: int = CHAIN) -> DataFrame:
    """k, d, up (0 or 1) for units (source, k, d, s, f), 0 < f < 1: the tree of chains.

    A source of any size is dealt by hash to chains of about ``chain``
    documents; each level has ``chain`` times fewer open documents.
    """
    counted = store.keep(units.groupBy("source").agg(F.ceil(F.count("*") / chain).cast("long").alias("buckets")), f"{name}-sources")
    most = counted.agg(F.max("buckets")).first()[0] or 0
    if not most:
        return units.select("k", "d", F.lit(0).alias("up"))
    bucket = F.pmod(F.xxhash64("k", "d", F.lit(seed)), F.col("buckets"))
    level = with_source(units, counted).select("source", "k", "d", "s", "f", bucket.alias("bucket"))
    rounded, depth = [], 0
    while True:
        got = store.keep(_chains(level, seed + depth), f"{name}{depth}")
        rounded.append(got.select(F.inline("done")))
        level = got.where("carry is not null").select("source", "carry.*", F.floor(F.col("bucket") / chain).alias("bucket"))
        depth += 1
        if most <= 1:
            break
        most = -(-most // chain)
    rounded.append(level.select("k", "d", (_uniform("k", "d", F.lit(seed)) < F.col("f")).cast("int").alias("up")))
    out = rounded[0]
    for r in rounded[1:]:
        out = out.unionByName(r)
    return out


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, chain: int = CHAIN, seed: int = 1) -> DataFrame:
    """The frame with size, source_size, target, copies and taken of each row.

    Documents much larger than their source's mean are rounded first; what their
    last open document misses of the target is spread over the fractions of
    the others, so that the last document left open is a small one.
    """
    store = Store(docs.sparkSession, "mixing")
    docs = docs.drop("size", "source_size", "target", "copies", "taken")
    id_ = F.col("doc_id").cast("long")
    k, d, of_k, of_d, n, whole, extra = names = fresh(docs, "k", "d", "of_k", "of_d", "n", "whole", "more")
    keyed = docs.withColumns({k: F.xxhash64(F.coalesce("text", F.lit("")), "source", id_.isNull()), d: F.coalesce(id_, F.lit(0))})
    rows = store.keep(keyed.groupBy("source", F.col(k).alias("k"), F.col(d).alias("d")).agg(F.max(n_words()).alias("size"), F.count("*").alias("n")), "rows")
    stats = store.keep(rows.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum(F.when(F.col("size") > 0, F.col("n"))).alias("docs")), "stats")
    goal = with_source(targets(stats.select("source", "source_size"), weights, cap), stats.select("source", "docs"))
    ratio = F.least(F.lit(float(cap)), F.coalesce(F.col("target") / F.nullif(F.col("source_size"), F.lit(0)), F.lit(0.0)))
    goal = store.keep(goal.select("source", "source_size", "target", "docs", F.floor(ratio).alias("whole"), (ratio - F.floor(ratio)).alias("f")), "goal")
    weighed = with_source(rows, goal)

    is_large = F.col("size") * F.col("docs") > LARGE * F.col("source_size")
    open_ = weighed.where("size > 0 and f > 0").select("source", "k", "d", F.col("size").cast("double").alias("s"), "n", "f", is_large.alias("large"))
    large = store.keep(_whole_rows(open_.where("large")), "large")
    first = store.keep(round_together(_units(large), store, "large", seed, chain), "large-up")
    # decimals, so that no order of adding matters
    exact = lambda c: F.sum(c.cast("decimal(28,6)"))
    left_over = large.join(first, ["k", "d"]).groupBy("source").agg(exact(F.col("s") * (F.col("rest") - F.col("up"))).alias("missed"))
    small = open_.where("not large")
    shift = (
        small.groupBy("source").agg(exact(F.col("s") * F.col("n")).alias("all"))
        .join(left_over.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")))
        .select("source", (F.col("missed").cast("double") / F.col("all").cast("double")).alias("shift"))
    )
    shifted = with_source(small, store.keep(shift, "shift"), left=True)
    moved = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("f") + F.coalesce("shift", F.lit(0.0))))
    small = store.keep(_whole_rows(shifted.withColumn("f", moved)), "small")
    second = round_together(_units(small), store, "small", seed + 100, chain)
    more = large.unionByName(small).select("k", "d", "more").join(first.unionByName(second), ["k", "d"], "left")
    more = store.keep(more.select("k", "d", (F.col("more") + F.coalesce("up", F.lit(0))).alias("more")), "more")
    # ``more`` of the n equal rows are taken once more than the others
    decided = weighed.join(more, ["k", "d"], "left").select(F.col("k").alias(of_k), F.col("d").alias(of_d), F.col("n").alias(n), "size", "source_size", "target", F.col("whole").alias(whole), F.coalesce("more", F.lit(0)).alias(extra))
    decided = store.keep(decided, "decided")
    same = (F.col(k) == F.col(of_k)) & (F.col(d) == F.col(of_d))
    told = keyed.join(decided.where(F.col(n) == 1), same).withColumn("copies", (F.col(whole) + F.col(extra)).cast("int"))
    again = decided.where(F.col(n) > 1)
    if again.limit(1).count():
        told = told.unionByName(_numbered(keyed.join(again, same), names, store))
    return told.withColumn("taken", F.col("size") * F.col("copies")).select(*(f"`{c}`" for c in docs.columns), "size", "source_size", "target", "copies", "taken")


def _whole_rows(rows: DataFrame) -> DataFrame:
    """Of n rows wanted f times each: ``more`` rows that are taken, and the ``rest`` of a row."""
    wanted = F.col("n") * F.col("f")
    return rows.select("source", "k", "d", "s", F.floor(wanted).alias("more"), (wanted - F.floor(wanted)).alias("rest"))


def _units(rows: DataFrame) -> DataFrame:
    return rows.where("rest > 0").select("source", "k", "d", "s", F.col("rest").alias("f"))


def _numbered(rows: DataFrame, names: list[str], store: Store) -> DataFrame:
    """Rows that have equals, with copies by their number among these.

    They are stored with their task and place in it; numbers within a task and
    the counts of the tasks before make a row's number, so equal rows of any
    number meet in no task.
    """
    k, d, *_, whole, extra = names
    task, place, before, number = fresh(rows, "task", "place", "before", "number")
    held = store.keep(rows.withColumns({task: F.spark_partition_id(), place: F.monotonically_increasing_id()}), "repeated")
    ahead = W.partitionBy(k, d).orderBy(task).rowsBetween(W.unboundedPreceding, -1)
    counts = held.groupBy(k, d, task).agg(F.count("*").alias("m")).select(k, d, task, F.coalesce(F.sum("m").over(ahead), F.lit(0)).alias(before))
    numbered = held.withColumn(number, F.row_number().over(W.partitionBy(k, d, task).orderBy(place))).join(counts, [k, d, task])
    taken = F.col(whole) + (F.col(before) + F.col(number) <= F.col(extra)).cast("int")
    return numbered.withColumn("copies", taken.cast("int")).drop(task, place, before, number)


def repeated(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The mix itself: each row as often as it is taken."""
    (turn,) = fresh(mixed, "turn")
    return mixed.where("copies > 0").withColumn(turn, F.explode(F.sequence(F.lit(1), "copies"))).select(*columns)
