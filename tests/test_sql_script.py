"""Statements of SQL Server's kind on Spark: a script's own tables, rewrites, and files that do not see each other."""

from __future__ import annotations

import os

import pytest

from tabloom.operators.pipeline import run_pipeline, sql_parses, try_run_sql_file, try_run_sql_query, validate_pipeline_control_file
from tabloom.operators.pipeline_sql import split_batches
from tabloom.operators.sql_script import SqlScript, statements, temp_view
from tabloom.sources import work

PEOPLE = """
CREATE TABLE #temp (
    col1 INT NOT NULL
    , col2 VARCHAR(5)
    , [col 3] DATE
    , PRIMARY KEY (col1)
);
INSERT INTO #temp
VALUES
(1, 'aaa', '2020-01-01'),
(NULL, 'bbb', '2021-01-01'),
(3, NULL, NULL)
"""


def ran(spark, code):
    script, out = SqlScript(spark), None
    for batch in split_batches(code):
        if batch.code.strip():
            out = script.run(batch.code)
    return script, out


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize(
    ("code", "want"),
    [
        ("SELECT 1\nSELECT 2", 2),
        ("SELECT 1\nUNION ALL\nSELECT 2\nEXCEPT\nSELECT 3", 1),
        ("WITH a AS (\nSELECT 1 AS x\n)\nSELECT x FROM a\nDROP TABLE IF EXISTS #t", 2),
        ("INSERT INTO #t (a, b)\nSELECT 1, 2\nINSERT INTO #t\nVALUES (1, 2)\nSELECT * FROM #t", 3),
        ("UPDATE #t\nSET a = 1\nWHERE b = 2\nSET NOCOUNT ON\nSELECT 1", 3),
        ("IF OBJECT_ID('tempdb..#t') IS NOT NULL\nDROP TABLE #t\nSELECT 1 AS a\nINTO #t", 2),
        ("CREATE OR REPLACE TEMP VIEW v AS\nSELECT 1", 1),
        ("SELECT (\nSELECT 1\n) AS x", 1),
    ],
)
def test_statements_of_a_batch(code, want):
    assert len(statements(code)) == want


def test_own_tables(spark):
    script, out = ran(spark, PEOPLE + "; SELECT TOP 2 col1, [col 3] AS day FROM #temp ORDER BY col1 DESC; SELECT COUNT(*) AS n, SUM(col1) AS s FROM #TEMP")
    assert rows(out) == [(3, 4)] and script.session.table(temp_view("#temp")).columns == ["col1", "col2", "col 3"]
    out = script.run("WITH step1 AS (\nSELECT *\nFROM #temp\nWHERE [col 3] IS NOT NULL\n)\nSELECT SUM(col1) AS total_value\nFROM step1")
    assert rows(out) == [(1,)]
    script.run("SELECT col2, LEN(ISNULL(col2, '')) AS size INTO #sizes FROM #temp\nDELETE FROM #temp WHERE col2 = 'aaa'\nUPDATE #temp SET col2 = CONCAT('x', col1), [col 3] = '1999-01-01' WHERE col1 IS NOT NULL\nALTER TABLE #temp ADD more BIT, w MONEY\nALTER TABLE #temp DROP COLUMN w")
    assert rows(script.session.table(temp_view("#sizes"))) == [("aaa", 3), ("bbb", 3), (None, 0)]  # as it was when it was made
    assert [(r.col1, r.col2, str(r["col 3"]), r.more) for r in script.run("SELECT * FROM #temp").orderBy("col2").collect()] == [(None, "bbb", "2021-01-01", None), (3, "x3", "1999-01-01", None)]
    script.run("INSERT INTO #temp (col2, col1)\nSELECT 'new', 9\nTRUNCATE TABLE #sizes\nINSERT #sizes VALUES (N'it''s', 4)")
    assert rows(script.run("SELECT col1, col2 FROM #temp WHERE col1 > 5")) == [(9, "new")] and rows(script.run("SELECT * FROM #sizes")) == [("it's", 4)]
    script.run("IF OBJECT_ID('tempdb..#temp') IS NOT NULL DROP TABLE #temp\nDROP TABLE IF EXISTS #temp, #sizes")
    with pytest.raises(Exception, match="temp__temp|cannot be found"):
        script.run("SELECT * FROM #temp")
    with pytest.raises(ValueError, match="no table"):
        script.run("DROP TABLE #gone")


@pytest.mark.parametrize(
    ("code", "want"),
    [
        ("SELECT TOP (2) id FROM (SELECT TOP 3 id FROM range(10) ORDER BY id DESC) x ORDER BY id", [(7,), (8,)]),
        ("SELECT DISTINCT TOP 1 id % 2 AS x FROM range(10) ORDER BY x", [(0,)]),
        ("SELECT TOP 1 id FROM range(3) UNION ALL SELECT TOP 1 id + 10 FROM range(3)", [(0,), (10,)]),
        ("SELECT IIF(id > 0, N'y', 'n') AS [a b], CAST('2' AS NVARCHAR(5)) AS t, CAST(1.5 AS FLOAT) AS f, CAST(1 AS BIT) AS b FROM range(1)", [("n", "2", 1.5, 1)]),
        ("SELECT array(5, 6)[1] AS x, isnull(NULL) AS y, '[a] #b TOP 1' AS z", [(6, True, "[a] #b TOP 1")]),
        ("USE [db]\nSET NOCOUNT ON\nPRINT 'hello'\nSELECT 1 AS one", [(1,)]),
        ("SELECT n.id FROM [no_db].[dbo].[script_numbers] n WITH (NOLOCK) JOIN [script_numbers] AS m ON m.id = n.id", [(0,), (1,)]),
    ],
)
def test_rewrites(spark, code, want):
    spark.sql("CREATE TABLE IF NOT EXISTS script_numbers USING parquet AS SELECT id FROM range(2)")
    try:
        assert rows(SqlScript(spark).run(code)) == want
    finally:
        spark.sql("DROP TABLE script_numbers")


def test_real_tables(spark):
    script = SqlScript(spark)
    try:
        script.run("DROP TABLE IF EXISTS [db].[dbo].[script_made]\nCREATE TABLE [script_made] (a INT, b NVARCHAR(10))\nINSERT INTO [db].[dbo].[script_made] (b) VALUES ('x')\nSELECT id AS a INTO [script_ids] FROM range(3)")
        assert rows(spark.table("script_made")) == [(None, "x")] and spark.table("script_ids").count() == 3
    finally:
        for t in ("script_made", "script_ids"):
            spark.sql(f"DROP TABLE IF EXISTS {t}")


@pytest.mark.parametrize("code", ["EXEC thing", "IF 1 = 1 SELECT 1", "UPDATE #temp SET col1 = 2 FROM #temp t", "INSERT INTO #temp SELECT 1", "SELECT FROM WHERE"])
def test_statements_that_are_refused(spark, code):
    script, _ = ran(spark, PEOPLE)
    with pytest.raises(Exception):
        script.run(code)


def test_files_do_not_see_each_others_tables(spark, tmp_path):
    (tmp_path / "setup.sql").write_text("-- makes a table\nDROP TABLE IF EXISTS #temp\nGO\n" + PEOPLE + "GO\nSELECT TOP 3 col1 FROM #temp\n")
    (tmp_path / "calculate.sql").write_text("SELECT *\nFROM #temp;\n")
    (tmp_path / "wrong.sql").write_text("SELEC TOP 3 x FROM #temp;\n")
    names = ("setup.sql", "calculate.sql")
    control = [{"order": str(i), "folder": str(tmp_path), "file": f} for i, f in enumerate(names)]
    assert validate_pipeline_control_file(control, spark).ok
    assert not validate_pipeline_control_file([{"folder": str(tmp_path), "file": "wrong.sql"}], spark).ok
    status = [r["status"] for r in run_pipeline(control, spark).rows]
    assert status[0] == "Successful completion" and status[1].startswith("Stopped with error: lines 1 to 2")
    assert sql_parses(spark, "SELECT TOP 3 [a b] FROM [x].[y].[z] WITH (NOLOCK)") is None and "PARSE" in sql_parses(spark, "SELECT (a FROM b")


def test_results_stay_off_the_driver_and_stored_tables_go(spark, tmp_path, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    monkeypatch.setattr(DataFrame, "collect", lambda self: pytest.fail("rows came to the driver"))
    dropped = []
    monkeypatch.setattr("tabloom.operators.sql_script.drop", lambda session, path: (dropped.append(path), work.drop(session, path)))
    (tmp_path / "a.sql").write_text("SELECT id INTO #t FROM range(100)\nSELECT * FROM #t, #t AS u\n")
    assert try_run_sql_file(spark, str(tmp_path / "a.sql"))["status"] == "Successful completion"
    assert try_run_sql_query(spark, "SELECT * FROM range(1000000)")["status"] == "Successful completion"
    assert try_run_sql_query(spark, "SELECT raise_error('x') FROM range(10)")["status"].startswith("Stopped with error")
    assert len(dropped) == 1 and not os.path.exists(dropped[0].removeprefix("file://"))
