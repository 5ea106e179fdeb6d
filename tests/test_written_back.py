"""Assembly that changes its master table in place, and what is left when a step fails."""

from __future__ import annotations

import pytest
from pyspark.sql import SparkSession

from tabloom.operators.assembly import run_assembly
from tabloom.operators.report import SUCCESS
from tabloom.sources.tables import mend_table, replace_table
from tests.test_sweep import control, rows_of

NAME = "written_master"


@pytest.fixture
def tables(spark):
    for t in (NAME, f"{NAME}__old", f"{NAME}__staged"):
        spark.sql(f"DROP TABLE IF EXISTS {t}")
    base = spark.createDataFrame([(1, "2012-01-01", "2012-12-31"), (2, "2012-01-01", "2012-12-31"), (2, "2012-01-01", "2012-12-31"), (None, None, None)], "uid int, start string, stop string")
    base.write.saveAsTable(NAME)
    yield spark.createDataFrame([(1, "2012-02-01", "2012-02-29", 10), (2, "2012-12-31", "2013-01-01", 8)], "id int, s string, e string, v int")
    for t in (NAME, f"{NAME}__old", f"{NAME}__staged"):
        spark.sql(f"DROP TABLE IF EXISTS {t}")


def test_the_master_is_changed_in_place(spark, tables):
    got = run_assembly(spark, [control(), control(output_name='"most"', output_method="MAX")], f"[db].[dbo].[{NAME}]", {"events": tables}, write_to=NAME)
    assert got.status.rows[0]["status"] == SUCCESS
    assert rows_of(spark.table(NAME)) == rows_of(got.df) and spark.table(NAME).columns == ["uid", "start", "stop", "out", "most"]
    run_assembly(spark, [control(output_method="SUM")], NAME, {"events": tables}, write_to=NAME)
    assert spark.table(NAME).columns == ["uid", "start", "stop", "most", "out"]  # a column that is there gives way, and moves
    assert rows_of(spark.table(NAME)) == sorted([(1, "2012-01-01", "2012-12-31", 10, 10), *[(2, "2012-01-01", "2012-12-31", 8, 8)] * 2, (None,) * 5], key=str)
    assert not spark.catalog.tableExists(f"{NAME}__old") and not spark.catalog.tableExists(f"{NAME}__staged")


@pytest.mark.parametrize("step", ["RENAME TO `written_master__old`", "ALTER TABLE `written_master__staged`"])
def test_a_failure_between_steps_leaves_the_old_table(spark, tables, monkeypatch, step):
    before, sql = rows_of(spark.table(NAME)), SparkSession.sql

    def broken(self, text, *args, **kwargs):
        if step in text:
            raise RuntimeError("lost")
        return sql(self, text, *args, **kwargs)

    monkeypatch.setattr(type(spark), "sql", broken)
    with pytest.raises(RuntimeError, match="lost"):
        run_assembly(spark, [control()], NAME, {"events": tables}, write_to=NAME)
    monkeypatch.undo()
    assert rows_of(spark.table(NAME)) == before and not spark.catalog.tableExists(f"{NAME}__old")


def test_rows_are_counted_and_lost_runs_mended(spark, tables):
    before = rows_of(spark.table(NAME))
    with pytest.raises(ValueError, match="has 4 rows, and its new version 2"):
        replace_table(spark, NAME, spark.table(NAME).limit(2))
    spark.sql(f"ALTER TABLE {NAME} RENAME TO {NAME}__old")  # a driver lost between the renames
    run_assembly(spark, [control()], NAME, {"events": tables}, write_to=NAME)
    assert rows_of(spark.table(NAME).drop("out")) == before
    spark.table(NAME).write.saveAsTable(f"{NAME}__old")  # a driver lost before the old table went
    mend_table(spark, NAME)
    assert not spark.catalog.tableExists(f"{NAME}__old") and spark.table(NAME).count() == 4
