import os
from pathlib import Path

import pytest

from tabloom.functions.delimiters import add_delimiters, is_delimited, no_obvious_escaping_injection, read_cell, remove_delimiters
from tabloom.operators.ddl import add_column_sql, add_columns, drop_column_sql
from tabloom.operators.types import is_valid_data_type, spark_type
from tabloom.sources import paths
from tabloom.sources.controlfile import ControlTable, as_control_table, keyword, load_control_file, merge_progress, save_control_file, save_control_file_w_progress
from tabloom.sources.names import make_name, make_names, make_unique, sql2id, tolower_colnames
from tabloom.sources.sinks import append_csv, format_value
from tabloom.sources.tables import Catalog, load_csv
from tabloom.sources.xlsx import read_sheet, sheet_names, write_sheet


def test_names():
    assert make_unique(["group", "group", "a", "group", "group.1"]) == ["group", "group.2", "a", "group.3", "group.1"]
    assert make_names(["GROUP", "GROUP", "number of businesses", "2x", "_y", "if", ""]) == ["GROUP", "GROUP.1", "number.of.businesses", "X2x", "X_y", "if.", "X"]
    assert make_name("employee count p%") == "employee.count.p."
    assert keyword("COUNT.1") == keyword("count05") == "count"
    assert sql2id("[db].[my schema].[t.x]") == ["db", "my schema", "t.x"] and sql2id("a.b") == ["a", "b"]


def test_csv_control_file(tmp_path):
    p = tmp_path / "control.csv"
    p.write_bytes("﻿ENABLED,order,GROUP,GROUP,NOTE\nTRUE, 2 , a ,,x\n,,,,\nno,NA,NA,b,\n".encode())
    t = load_control_file(str(p))
    assert t.columns == ["ENABLED", "order", "GROUP", "GROUP.1", "NOTE"]
    assert t.rows == [
        {"ENABLED": "TRUE", "order": 2.0, "GROUP": "a", "GROUP.1": None, "NOTE": "x"},
        {"ENABLED": "no", "order": None, "GROUP": None, "GROUP.1": "b", "NOTE": None},
    ]
    assert len(t.enabled().rows) == 1
    with pytest.raises(ValueError):
        load_control_file(str(tmp_path / "x.txt"))
    assert as_control_table([]).rows == []


def test_xlsx_round_trip_keeps_other_sheets(tmp_path):
    p = str(tmp_path / "c.xlsx")
    write_sheet(p, [["a", "b & <c>"], ["1", ""], ["", " x "]], "one")
    assert sheet_names(p) == ["one"] and read_sheet(p, "one") == [["a", "b & <c>"], ["1", ""], ["", " x "]]
    table = load_control_file(p, "one")
    assert table.columns == ["a", "b....c."] and table.rows[1] == {"a": None, "b....c.": "x"}
    table.rows[0]["a"] = "changed"
    save_control_file(p, table, "one")
    assert load_control_file(p).rows[0]["a"] == "changed"
    with pytest.raises(ValueError):
        read_sheet(p, "two")


def test_merge_progress():
    control = ControlTable(["Enabled", "Name", "STATUS"], [{"Enabled": e, "Name": n, "STATUS": "old"} for e, n in (("TRUE", "a"), ("no", "b"), ("yes", "c"), ("1", "a"))])
    progress = ControlTable(["name", "start_time", "status"], [{"name": "a", "start_time": "now", "status": "new"}, {"name": "a", "start_time": "later", "status": "newer"}, {"name": "b", "start_time": "x", "status": "x"}])
    got = merge_progress(control, progress)
    assert got.columns == ["Enabled", "Name", "STATUS", "start_time"]
    assert [(r["STATUS"], r["start_time"]) for r in got.rows] == [("new", "now"), ("old", None), (None, None), ("new", "now")]


def test_saving_beside_an_existing_file(tmp_path):
    p = str(tmp_path / "c.csv")
    t = ControlTable(["a", "order"], [{"a": None, "order": 1.0}])
    assert save_control_file(p, t) == p and Path(p).read_text() == "a,order\n,1\n"
    assert save_control_file(p, t, overwrite=False) == str(tmp_path / "c (1).csv")
    assert save_control_file(p, t, overwrite=False) == str(tmp_path / "c (2).csv")
    assert paths.increment_file_name(str(tmp_path / "c (1).csv")) == str(tmp_path / "c (3).csv")
    new = save_control_file_w_progress(p, ControlTable(["a", "status"], [{"a": None, "status": "done"}]))
    assert load_control_file(new).rows[0]["status"] == "done"


def test_paths(tmp_path, monkeypatch):
    assert paths.adjust_file_path_handling(r"I:\a\\b") == "I:/a/b"
    assert paths.adjust_file_path_handling(r"I:\MAA\x", {"I:/MAA": "/mnt/lab/maa"}) == "/mnt/lab/maa/x"
    good, bad = tmp_path / "g.sql", tmp_path / "b.sql"
    good.write_text("a\n\nb\n")
    bad.write_text("a")
    assert paths.read_lines_utf8(str(good)) == ["a", "", "b"]
    for raw in (b"a", b"\xff\n"):
        bad.write_bytes(raw)
        with pytest.raises(ValueError):
            paths.read_lines_utf8(str(bad))
    slept = []
    (tmp_path / "~$c.xlsx").write_text("")
    assert paths.warn_if_excel_lockfile(str(tmp_path / "c.xlsx"), 3, slept.append) and slept == [3]
    assert not paths.warn_if_excel_lockfile(str(good))
    one, two = (paths.save_code_to_script("select 1", "a b", str(tmp_path / "debug")) for _ in range(2))
    assert one != two and os.path.exists(two)
    assert "summary" in paths.provide_example() and len(paths.provide_example("summary", str(tmp_path / "e"))) >= 2
    monkeypatch.setenv("TABLOOM_DATA_LAB", "1")
    assert paths.within_data_lab()


def test_delimiters_and_injection_guard():
    assert is_delimited(" [a] ", "[]") and not is_delimited("[a", "[") and add_delimiters("[a]", "[]") == "[a]" and add_delimiters("a", '"') == '"a"'
    assert remove_delimiters(" { x } ", "{}") == "x" and remove_delimiters("x", "[]") == "x"
    assert read_cell("{a + 1}").kind == "dynamic" and read_cell("[a]").text == "a" and read_cell('"1"').kind == "constant" and read_cell("a").kind == "column"
    assert no_obvious_escaping_injection("a == 'b' & (c > [d])")
    assert not any(map(no_obvious_escaping_injection, ("a; b", "a}", "'a", "(a", "a]")))


def test_types_and_ddl(spark):
    assert [spark_type(t) for t in ("INT", "tinyint", "DECIMAL(9,2)", "numeric", "VARCHAR(8)", "float NULL", "bit", "datetime2(7)")] == ["int", "smallint", "decimal(9,2)", "decimal(18,0)", "string", "double", "int", "timestamp"]
    assert is_valid_data_type("varchar (10)") and not is_valid_data_type("INTEGER") and not is_valid_data_type(None)
    assert drop_column_sql("t", ["a", "[b]"]) == "ALTER TABLE t DROP COLUMN IF EXISTS [a], [b];"
    assert drop_column_sql("t", ["a", "b"], sqlite=True).count("\n") == 1
    assert add_column_sql("t", ["a", "b"], ["INT", "DATE"]) == "ALTER TABLE t ADD [a] INT, [b] DATE;"
    with pytest.raises(ValueError):
        add_column_sql("t", ["a"], ["THING"])
    assert add_columns(spark.range(1), ["x"], ["FLOAT"]).dtypes == [("id", "bigint"), ("x", "double")]


def test_tables_and_sink(spark, tmp_path):
    spark.range(3).createOrReplaceTempView("plain_view")
    catalog = Catalog(spark, {"[db].[s].[Mine]": spark.range(2)})
    assert catalog.get("[DB].[s].[mine]").count() == 2 and catalog.get("[x].[y].[plain_view]").count() == 3 and catalog.find("[no].[such]") is None
    with pytest.raises(ValueError):
        tolower_colnames(spark.range(1).selectExpr("id AS a", "id AS A"))
    df = spark.createDataFrame([(1, 12345678.0, "a,\"b\"", None), (2, 0.1, None, True)], "i int, d double, t string, b boolean")
    out = str(tmp_path / "new" / "r.csv")
    append_csv(df, out)
    append_csv(df.limit(1), out)
    lines = Path(out).read_text().splitlines()
    assert lines[0] == '"i","d","t","b"' and lines[1] == '1,12345678,"a,""b""",NA' and lines[2] == "2,0.1,NA,TRUE" and len(lines) == 4
    assert format_value(1e-7) == "0.0000001" and format_value(float("nan")) == "NA"
    Path(tmp_path / "in.csv").write_text("﻿a,b\n1,NA\n2,x\n")
    loaded = load_csv(spark, str(tmp_path / "in.csv"), "loaded_view")
    assert [tuple(r) for r in loaded.collect()] == [(1, None), (2, "x")] and spark.table("loaded_view").columns == ["a", "b"]
