"""Summary rows that share a scan against rows apart."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tabloom.operators.summary import run_summary


def rows_of(df):
    return sorted((tuple(float(f"{x:.8e}") if isinstance(x, float) else x for x in r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def data(spark):
    df = spark.range(500).select("id", F.expr("nullif(id % 5, 4)").alias("g"), F.expr("nullif(concat('h', id % 3), 'h1')").alias("h"), (F.col("id") % 2 == 0).alias("even"), F.expr("case when id % 7 <> 0 then id / 4 end").alias("x"), F.expr("cast(id as decimal(10,2))").alias("d"), F.lit(None).cast("int").alias("hole"))
    return df.repartition(4)


ROWS = [
    {"LABEL": "a", "GROUP1": "g", "GROUP2": "h", "COUNT": "x", "SUM": "x", "SEED": "id"},
    {"LABEL": "b", "GROUP1": "h", "GROUP2": None, "COUNT": "hole", "SUM": "hole", "MIN": "x", "MAX": "h"},
    {"LABEL": "c", "GROUP1": "h", "GROUP2": "g", "SUM": "{ifelse(even, x, 1)}", "WHERE": "{id > 400 & even}"},
    {"LABEL": "d", "GROUP1": "even", "SUM": "d", "MAX": "d", "WHERE": "{id > 1000}"},
    {"LABEL": "e", "COUNT": "id", "SUM": "hole", "MIN": "even"},
    {"LABEL": "f", "GROUP1": "g", "DISTINCT": "h", "COUNT": "id"},
    {"LABEL": "g", "GROUP1": "g", "STDDEV": "x"},
    {"LABEL": "h", "GROUP1": "g", "GROUP2": "h", "COUNT": "x", "WHERE": "{g == 9}"},
]


@pytest.mark.parametrize("mode", ["rollup", "sets"])
@pytest.mark.parametrize("options", [{}, {"remove_na_from_groups": False}, {"null_mode": "sql"}])
def test_shared_rows_equal_rows_apart(data, mode, options):
    apart = run_summary(ROWS, data, **options).df
    together = run_summary(ROWS, data, share=mode, **options).df
    assert together.dtypes == apart.dtypes
    assert rows_of(together) == rows_of(apart) and len(rows_of(apart)) > 20
    empty = data.where("id < 0")
    assert rows_of(run_summary(ROWS, empty, share=mode, **options).df) == rows_of(run_summary(ROWS, empty, **options).df)


@pytest.mark.parametrize("mode", ["rollup", "sets"])
def test_eight_rows_are_one_scan(spark, sf_dir, mode):
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    rows = [{"GROUP1": g, "GROUP2": h, "COUNT": "l_quantity", "SUM": "l_tax", "WHERE": "{l_quantity > 10}"} for g in ("l_returnflag", "l_linestatus") for h in (None, "l_linenumber", "l_shipmode", "l_suppkey")]
    rows = [r for r in rows if r["GROUP2"] is None or r["GROUP2"] in df.columns]
    rows = (rows * 4)[:8]
    plan = run_summary(rows, df, share=mode).df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") == 1 and "GreaterThan(l_quantity,10.0)" in plan
    assert run_summary(rows, df).df._jdf.queryExecution().executedPlan().toString().count("Scan parquet") == 8
    assert rows_of(run_summary(rows, df, share=mode).df) == rows_of(run_summary(rows, df).df)


def test_ways_to_share_are_known(data):
    with pytest.raises(ValueError, match="share is one of"):
        run_summary(ROWS, data, share="somehow")


def test_distinct_counts_by_bitmaps(spark):
    df = spark.range(4000).select(
        F.expr("nullif(id % 4, 3)").alias("g"), F.expr("cast((id * 7919) % 900 - 450 as int)").alias("a"), F.expr("case when id % 3 > 0 then (id % 500) * 4294967296 end").alias("b"),
        F.expr("cast(id % 7 as tinyint)").alias("c"), F.expr("concat('t', id % 11)").alias("t"), F.lit(None).cast("bigint").alias("hole"), F.expr("nullif(id % 100, 0)").alias("e__min"), F.expr("id % 130").alias("e__max"),
    ).repartition(3)
    cells = {"DISTINCT1": "a", "DISTINCT2": "b", "DISTINCT3": "c", "DISTINCT4": "t", "ENTITY1": "hole", "ENTITY2": "a", "COUNT": "b", "SUM": "a", "DISTINCT5": "{a %% 10}"}
    rows = [{"LABEL": "groups", "GROUP": "g", **cells}, {"LABEL": "all", "GROUP": None, **cells}, {"LABEL": "two", "GROUP": "g", "DISTINCT1": "a", "WHERE": "{c == 2}"}, {"LABEL": "pair", "GROUP": "g", "ENTITY1": "e", "DISTINCT1": "c"}]
    for options in ({}, {"remove_na_from_groups": False}):
        plain, bits = (run_summary(rows, df, distinct=d, **options).df for d in ("sets", "bitmaps"))
        assert bits.dtypes == plain.dtypes and rows_of(bits) == rows_of(plain)
        empty = df.where("a > 1000")
        assert rows_of(run_summary(rows, empty, distinct="bitmaps", **options).df) == rows_of(run_summary(rows, empty, **options).df)
    three = [{"GROUP": "g", "DISTINCT1": "a", "DISTINCT2": "b", "DISTINCT3": "c"}]
    plans = [run_summary(three, df, distinct=d).df._jdf.queryExecution().optimizedPlan().toString() for d in ("sets", "bitmaps")]
    assert "Expand" in plans[0] and "Expand" not in plans[1]
    with pytest.raises(ValueError, match="distinct is one of"):
        run_summary(three, df, distinct="somehow")
