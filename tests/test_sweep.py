"""Overlap summaries by blocks of time against the join in pairs; one attach for all batches; names."""

from __future__ import annotations

import datetime as dt
import random
import warnings

import pytest
from pyspark.sql import functions as F

from tabloom.operators.assembly import METHODS, attach, measure_batch, run_assembly
from tabloom.operators.sweep import SWEPT


def control(**row):
    return {
        "population_uid": "[uid]", "period_start": "[start]", "period_end": "[stop]", "measure_table": "[events]", "measure_uid": "[id]", "measure_start": "[s]",
        "measure_end": "[e]", "measure_value": "[v]", "output_name": '"out"', "output_method": "COUNT", "output_type": "INT",
    } | row


TYPES = {"MIN": "FLOAT", "MAX": "FLOAT", "EXISTS": "INT", "COUNT": "BIGINT", "MEAN": "FLOAT", "DISTINCT": "BIGINT", "SUM": "FLOAT", "SUM_WITHIN": "FLOAT", "DURATION": "BIGINT"}
ROWS = [control(output_name=f'"{m.lower()}"', output_method=m, output_type=TYPES[m]) for m in METHODS if m != "ENTITY"]


def rows_of(df):
    """Doubles to nine digits, as the order of adding differs."""
    return sorted((tuple(float(f"{x:.8e}") if isinstance(x, float) else x for x in r) for r in df.collect()), key=str)


def made(spark, timed: bool, seed: int):
    """Spells and periods of few uids, some inverted, some missing, point events, values of unlike size."""
    rng = random.Random(seed)
    day = lambda n: dt.date(2019, 12, 1) + dt.timedelta(days=n)
    at = (lambda n: dt.datetime.combine(day(n // 24), dt.time(n % 24))) if timed else day
    span = 24 * 90 if timed else 400
    events, periods = [], []
    for _ in range(900):
        s = rng.randrange(span)
        e = s + rng.choice([0, 0, 1, 3, 30, 200, -2])
        v = rng.choice([None, 0.1, 1e9, -3.25, 7.0, rng.random()])
        events.append((rng.choice([1, 1, 1, 2, 3, None]), at(s) if rng.random() > 0.02 else None, at(e), v))
    for _ in range(120):
        s = rng.randrange(-10, span + 20)
        periods.append((rng.choice([1, 1, 2, 3, 4, None]), at(s), at(s + rng.choice([0, 1, 6, 30, 300, -1])) if rng.random() > 0.03 else None))
    kind = "timestamp" if timed else "date"
    return spark.createDataFrame(periods + periods[:5], f"uid int, start {kind}, stop {kind}"), spark.createDataFrame(events, f"id long, s {kind}, e {kind}, v double")


@pytest.mark.parametrize(("timed", "seed"), [(False, 1), (False, 2), (True, 3)])
def test_blocks_equal_pairs(spark, timed, seed):
    base, events = made(spark, timed, seed)
    plain = run_assembly(spark, ROWS, base, {"events": events}).df
    for least in (0, 200):  # every uid by blocks, or only the largest
        swept = run_assembly(spark, ROWS, base, {"events": events}, sweep=least).df
        assert rows_of(swept.select(plain.columns)) == rows_of(plain)
    assert plain.where("count > 10").count() > 5


def test_blocks_of_whole_numbers_texts_and_decimals(spark):
    base, events = made(spark, False, 5)
    events = events.select("id", F.col("s").cast("string").alias("s"), "e", F.round("v").cast("long").alias("v"), F.col("v").cast("decimal(18,4)").alias("d"), F.concat(F.lit("t"), F.round("v").cast("string")).alias("t"))
    rows = [control(output_method=m, output_name=f'"{m}_{c}"', measure_value=f"[{c}]", output_type=k) for m in SWEPT for c, k in (("v", "BIGINT"), ("d", "DECIMAL(30,4)")) if m not in ("SUM_WITHIN", "MEAN")]
    rows += [control(output_method=m, output_name=f'"{m}_t"', measure_value="[t]", output_type="VARCHAR(30)") for m in ("MIN", "MAX")]
    base = base.withColumn("uid", F.col("uid").cast("string"))
    plain = run_assembly(spark, rows, base, {"events": events}).df
    assert rows_of(run_assembly(spark, rows, base, {"events": events}, sweep=0).df) == rows_of(plain)


def test_a_uid_of_very_many_events_needs_no_pairs(spark):
    """A million events and ten thousand periods of one uid: no join makes more rows than events and periods times levels."""
    events = spark.range(1_000_000).select(F.lit(1).alias("id"), F.date_add(F.lit("2000-01-01").cast("date"), (F.col("id") % 3650).cast("int")).alias("s"), (F.col("id") % 30).cast("int").alias("n"), (F.col("id") % 101).cast("double").alias("v"))
    events = events.withColumn("e", F.date_add("s", F.col("n")))
    base = spark.range(10_000).select(F.lit(1).alias("uid"), F.date_add(F.lit("2000-01-01").cast("date"), (F.col("id") % 3000).cast("int")).alias("start"), (F.col("id") % 365).cast("int").alias("n")).withColumn("stop", F.date_add("start", F.col("n")))
    rows = [control(output_type="BIGINT"), control(output_method="DURATION", output_name='"days"', output_type="BIGINT")]
    df = run_assembly(spark, rows, base, {"events": events}, sweep=10_000).df
    got = {(r.start, r.stop): (r.out, r.days) for r in df.collect()}
    assert len(got) > 9000
    starts, first = [0] * 4000, dt.date(2000, 1, 1)
    active = [0] * 4001
    for i in range(1_000_000):
        s = i % 3650
        starts[s] += 1
        active[s] += 1
        active[min(s + i % 30 + 1, 4000)] -= 1
    for d in range(1, 4001):
        active[d] += active[d - 1]
    for (a, b), (n, days) in list(got.items())[:200]:
        p, q = (a - first).days, (b - first).days
        assert n == (active[p - 1] if p else 0) - ended_before(p) + sum(starts[p : q + 1]) and days == sum(active[p : q + 1])


def ended_before(p):
    """Events active on the day before p that end on it."""
    return sum(1 for s in range(max(0, p - 30), p) for i in range(s, 1_000_000, 3650) if s + i % 30 == p - 1)


def test_plans_of_blocks_have_no_pairs(spark):
    base, events = made(spark, False, 4)
    plan = measure_batch(base.where("start <= stop"), events.where("s <= e"), [control()], sweep=0)._jdf.queryExecution().optimizedPlan().toString()
    pairs = [x for x in plan.splitlines() if "Join" in x and "<=" in x]
    assert len(pairs) <= 3  # the uids that are not hot, and times that are out of order
    assert "of_block" in plan and "CartesianProduct" not in plan


def test_distinct_of_a_hot_uid_needs_no_pairs(spark):
    """Values that come back after a gap, within it and over it count once; the uids by blocks make no pairs of events and periods."""
    base, events = made(spark, False, 4)
    row = control(output_method="DISTINCT", output_type="BIGINT")
    plan = measure_batch(base, events, [row], sweep=200)._jdf.queryExecution().optimizedPlan().toString()
    assert "of_block" in plan and "distinct" not in plan
    day = lambda n: dt.date(2020, 1, 1) + dt.timedelta(days=n)
    spells = [(0, 3, 1.0), (2, 2, 1.0), (5, 6, 1.0), (6, 9, 1.0), (15, 14, 1.0), (30, 31, 1.0), (4, 4, None), (8, 8, float("nan")), (10, 10, float("nan")), (12, 7, 2.0), (11, 11, -0.0), (12, 12, 0.0), (40, 40, None)]
    events = spark.createDataFrame([(1, day(s), day(e), v) for s, e, v in spells], "id long, s date, e date, v double")
    base = spark.createDataFrame([(1, day(a), day(b)) for a in range(-1, 42) for b in range(a - 2, 43)], "uid int, start date, stop date")
    plain, swept = (run_assembly(spark, [row], base, {"events": events}, sweep=n).df for n in (None, 0))
    assert rows_of(swept) == rows_of(plain)
    want = {(day(a), day(b)): len({"nan" if v != v else v for s, e, v in spells if v is not None and a <= e and s <= b}) if any(a <= e and s <= b for s, e, _ in spells) else None for a in range(-1, 42) for b in range(a - 2, 43)}
    assert {(r.start, r.stop): r.out for r in swept.collect()} == want


def test_one_join_to_the_master_for_all_batches(spark):
    base, events = made(spark, False, 6)
    tables = {f"t{i}": events for i in range(4)}
    for n in (1, 2, 4):
        df = run_assembly(spark, [control(measure_table=f"[t{i}]", output_name=f'"o{i}"') for i in range(n)], base, tables).df
        assert df.columns == [*base.columns, *(f"o{i}" for i in range(n))]
        assert df._jdf.queryExecution().analyzed().toString().count("Join ") == n + 1
    assert df.where("not o3 <=> o0").count() == 0 and df.where("o3 > 1").count() and df.count() == base.count()


def test_batches_of_unlike_keys_and_outputs_that_are_keys(spark):
    base, events = made(spark, False, 7)
    base = base.withColumn("late", F.col("stop"))
    rows = [control(), control(period_end='"2020-03-01"', output_name='"until"'), control(measure_value="[e]", output_method="MAX", output_type="DATE", output_name='"late"', measure_end="[s]"), control(period_end="[late]", output_name='"then"')]
    got = run_assembly(spark, rows, base, {"events": events}).df
    assert got.columns == ["uid", "start", "stop", "out", "until", "late", "then"]
    one = run_assembly(spark, rows[:3], base, {"events": events}).df
    two = run_assembly(spark, rows[3:], one, {"events": events}).df
    assert rows_of(got) == rows_of(two)


def test_columns_of_any_name_are_kept(spark):
    base, events = made(spark, False, 8)
    names = ["_uid", "_ps", "_pe", "_new0", "_kuid", "_kps", "uid_", "ps", "out0", "__uid", "_OF_UID", "v0"]
    odd = base.withColumns({n: F.lit(i) for i, n in enumerate(names)})
    plain = run_assembly(spark, [control(), control(output_name='"_new1"', output_method="SUM")], base, {"events": events}).df
    got = run_assembly(spark, [control(), control(output_name='"_new1"', output_method="SUM")], odd, {"events": events.withColumns({n: F.lit("x") for n in ("muid", "ms", "v0", "out0")})}).df
    assert got.columns == [*odd.columns, "out", "_new1"]
    assert rows_of(got.drop(*names)) == rows_of(plain) and all(tuple(r[n] for n in names) == tuple(range(len(names))) for r in got.collect())
    assert attach(odd, []).columns == odd.columns


def test_times_that_cannot_be_read_are_counted(spark):
    base = spark.createDataFrame([(1, "2020-01-01", "2020-12-31"), (1, "last year", "2020-12-31")], "uid int, start string, stop string")
    events = spark.createDataFrame([(1, "2020-02-01", "2020-02-02", 1), (1, "soon", "2020-02-02", 1), (1, "2020-02-30", None, 1)], "id int, s string, e string, v int")
    with warnings.catch_warnings(record=True) as said:
        warnings.simplefilter("always")
        got = run_assembly(spark, [control()], base, {"events": events}, execute=True)
    text = " ".join(str(w.message) for w in said)
    assert "1 values of period_start [start] in the master" in text and "2 values of measure_start [s] in [events]" in text and "period_end" not in text
    assert [r.out for r in got.df.orderBy("start").collect()] == [1, None]
