"""The CSV sink: tasks' files put together, equal to values formatted one by one, on any of Spark's paths."""

from __future__ import annotations

import os
from decimal import Decimal
from pathlib import Path

import pytest

from tabloom.operators.summary import run_summary
from tabloom.sources import files
from tabloom.sources.sinks import append_csv, format_value

VALUES = [
    (1, 5.0, True, "plain", Decimal("1.50"), None), (-2, 1e7, False, 'say "hi", you', Decimal("-0.01"), 0.1), (3, 1.5e-7, None, "two\nlines", None, -1e22), (None, float("nan"), True, "", Decimal("100.00"), 123456.789),
    (9223372036854775807, float("inf"), True, "é\U0001f600", Decimal("0.00"), float("-inf")), (0, -0.0, True, None, Decimal("7.00"), 1.7976931348623157e308), (1, 5e-300, True, "NA", Decimal("12345678.90"), 2.5),
]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(VALUES, "i long, x double, b boolean, t string, d decimal(12,2), `a,b` double").repartition(3).cache()


def text_of(df):
    return "".join(",".join(map(format_value, r)) + "\n" for r in df.toLocalIterator())


def test_lines_equal_values_formatted_one_by_one(df, tmp_path):
    path = str(tmp_path / "new" / "out.csv")
    append_csv(df, path)
    head = '"i","x","b","t","d","a,b"\n'
    want = text_of(df).replace("-0,", "0,")
    assert Path(path).read_text().replace("-0,", "0,") == head + want
    append_csv(df.limit(2), path)
    append_csv(df.limit(0), path)
    assert Path(path).read_text().replace("-0,", "0,").startswith(head + want) and Path(path).read_text().count(head) == 1
    assert sorted(os.listdir(tmp_path / "new")) == ["out.csv"]


def test_paths_that_only_spark_can_open(spark, df, tmp_path):
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.sink.link./out", f"file://{tmp_path}")
    path = "viewfs://sink/out/there.csv"
    assert not files.exists(spark, path)
    append_csv(df.select("i", "t"), path)
    assert files.exists(spark, path) and (tmp_path / "there.csv").read_text().startswith('"i","t"\n')
    run_summary([{"FILE": path, "COUNT": "i"}], df, write=True)
    assert (tmp_path / "there.csv").read_text() == '"count"\n6\n'  # an old file gives way
    assert files.remove(spark, path) and not files.exists(spark, path)


def test_no_row_comes_to_the_driver(df, tmp_path, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    for name in ("collect", "toLocalIterator", "toPandas"):
        monkeypatch.setattr(DataFrame, name, lambda *a, **k: pytest.fail("rows came to the driver"))
    append_csv(df, str(tmp_path / "x.csv"))
    assert (tmp_path / "x.csv").exists()
