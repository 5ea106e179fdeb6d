"""The four tools on small tables with results worked out by hand."""

import random
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tabloom.functions import rounding
from tabloom.operators.assembly import run_assembly, sql_file_exists_and_contains, validate_assembly_control_file
from tabloom.operators.confidential import run_confidential, suppression_format_extract, validate_confidential_control_file
from tabloom.operators.pipeline import run_pipeline, try_run_py_file, try_run_sql_query, validate_pipeline_control_file
from tabloom.operators.pipeline_sql import read_and_prepare_sql_code, remove_sql_comments, sql_cmd_mode_fix
from tabloom.operators.report import PLANNED, SUCCESS
from tabloom.operators.summary import run_summary, validate_summary_control_file
from tabloom.sources.controlfile import load_control_file


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# summary


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame(
        [(1, "North", 10.0, None, 1, 5), (2, "North", None, None, 1, 6), (3, "South", 30.5, None, None, 7), (4, None, 40.0, None, 2, 8), (-5, "South", 2.0, None, 3, 7)],
        "UID int, Region string, Income double, ent string, firm__min int, firm__max int",
    )


def test_all_kinds_of_summaries(people):
    got = run_summary([{"LABEL": "x", "GROUP1": "[REGION]", "DISTINCT": "income", "COUNT1": "income", "SUM": "uid", "STDDEV": "income", "MAX": "income", "MIN": "income", "ENTITY": "firm", "SEED": "uid"}], people)
    assert got.df.columns == ["label", "grplabel1", "group1", "distinct", "count1", "sum", "stddev", "max", "min", "entity", "seed"]
    north, south = rows(got.df)
    assert north == ("x", "region", "North", 1, 1, 3, None, 10.0, 10.0, 3, 3)
    assert south[3:6] == (2, 2, -2) and south[6] == pytest.approx(20.15254) and south[9:] == (2, 98)


def test_missing_groups_empty_entity_and_text_of_groups(people):
    control = [{"GROUP1": "income", "COUNT": "uid"}, {"GROUP1": "region", "COUNT": "uid", "ENTITY": "ent"}]
    got = rows(run_summary(control, people).df)
    assert ("income", "10", 1, None) in got and ("income", "30.5", 1, None) in got and ("region", "South", 2, None) in got and len(got) == 6
    kept = run_summary(control, people, remove_na_from_groups=False).df
    assert kept.where("group1 is null").count() == 2


def test_a_row_that_fails_leaves_the_others(people):
    control = [{"COUNT": "uid"}, {"COUNT": "{nonsense(uid)}"}]
    with pytest.raises(ValueError, match="nonsense"):
        run_summary(control, people)
    got = run_summary(control, people, partial_output=True)
    assert rows(got.df) == [(5,)]
    assert [r["status"] == PLANNED for r in got.status.rows] == [True, False] and got.status.rows[1]["status"].startswith("Stopped with error")


def test_result_files_and_progress(people, tmp_path):
    control = tmp_path / "control.csv"
    control.write_text("ENABLED,FILE,LABEL,GROUP,GROUP,COUNT,NOTES\nTRUE,one.csv,a,region,,uid,\nTRUE,one.csv,b,,income,uid,\nTRUE,two.csv,c,,,uid,n\nFALSE,three.csv,d,,,uid,\n")
    (tmp_path / "one.csv").write_text("old\n")
    run_summary(str(control), people, save_folder=str(tmp_path), write=True, debug_folder=str(tmp_path / "debug"))
    lines = (tmp_path / "one.csv").read_text().splitlines()
    assert lines[0] == '"label","grplabel","group","grplabel.1","group.1","count"' and len(lines) == 7 and '"a","region","North",NA,NA,2' in lines
    assert (tmp_path / "two.csv").read_text().splitlines()[1] == '"c",NA,NA,NA,NA,5' and not (tmp_path / "three.csv").exists()
    after = load_control_file(str(control))
    assert [r["status"] for r in after.rows] == [SUCCESS] * 3 + [None] and len(list((tmp_path / "debug").iterdir())) == 2


@pytest.mark.parametrize(
    ("row", "why"),
    [
        ({"LABEL": "x"}, "at least one"), ({"COUNT": "nope"}, "does not have"), ({"GROUP": "{region}", "COUNT": "uid"}, "expression"),
        ({"COUNT": "{uid; 1}"}, "unpaired|;"), ({"SUM": "region"}, "no number"), ({"GROUP1": "uid", "GROUP2": "uid", "COUNT": "uid"}, "twice"),
        ({"COUNT": "uid", "WHERE": "{uid >}"}, "expression"), ({"GROUP": "uid", "COUNT": "uid", "ENTITY": "firm"}, "grouped and summarised"),
    ],
)
def test_summary_validator(people, row, why):
    report = validate_summary_control_file([{"ENABLED": "TRUE", **row}], people)
    assert not report.ok and any(__import__("re").search(why, p) for p in report.problems)


def test_summary_warnings_and_files(people):
    report = validate_summary_control_file([{"COUNT": "ent", "ODD": "x"}], people)
    assert report.ok and len(report.warnings) == 2
    mixed = [{"ENABLED": e, "FILE": "a.csv", "COUNT": "uid"} for e in ("TRUE", "no")]
    assert not validate_summary_control_file(mixed, people).ok and validate_summary_control_file(mixed, people, save_file="x.csv").ok


def test_summary_plan_is_pruned_and_stays_in_the_jvm(spark, sf_dir):
    df = run_summary([{"GROUP1": "l_returnflag", "COUNT": "l_tax", "WHERE": "{l_quantity > 10}"}], spark.read.parquet(f"{sf_dir}/lineitem.parquet")).df
    plan = df._jdf.queryExecution().toString()
    assert "GreaterThan(l_quantity,10.0)" in plan and "ReadSchema: struct<l_quantity:double,l_tax:double,l_returnflag:string>" in plan and "Python" not in plan


# assembly


@pytest.fixture(scope="module")
def spells(spark):
    base = spark.createDataFrame([(1, "2012-01-01", "2012-12-31"), (2, "2012-01-01", "2012-12-31"), (2, "2013-01-01", "2013-12-31"), (None, "2012-01-01", "2012-12-31")], "uid int, start string, stop string")
    events = spark.createDataFrame(
        [(1, "2012-02-01", "2012-02-29", 10, "a"), (1, "2012-02-15", "2012-03-15", None, "b"), (1, "2011-12-31", "2012-01-01", 4, "a"), (2, "2012-12-31", "2013-01-01", 8, "z"), (2, "2012-06-10", "2012-06-08", 5, None), (3, "2012-01-01", "2012-01-02", 1, "q")],
        "id int, s string, e string, v int, kind string",
    )
    return base, events


def control(**row):
    return {
        "population_uid": "[uid]", "period_start": "[start]", "period_end": "[stop]", "measure_table": "[db].[dbo].[events]", "measure_uid": "[id]", "measure_start": "[s]",
        "measure_end": "[e]", "measure_value": "[v]", "output_name": '"out"', "output_method": "COUNT", "output_type": "INT",
    } | row


@pytest.mark.parametrize(
    ("method", "kind", "value", "want"),
    [
        ("COUNT", "INT", "[v]", [2, 2, 1, None]), ("SUM", "INT", "[v]", [14, 13, 8, None]), ("MEAN", "FLOAT", "[v]", [7.0, 6.5, 8.0, None]), ("MIN", "INT", "[v]", [4, 5, 8, None]),
        ("MAX", "VARCHAR(1)", "[kind]", ["b", "z", "z", None]), ("EXISTS", "INT", "[v]", [1, 1, 1, None]), ("DISTINCT", "INT", "[kind]", [2, 1, 1, None]),
        ("DURATION", "INT", '"1"', [29 + 30 + 1, 1 - 1, 1, None]), ("SUM_WITHIN", "FLOAT", "[v]", [12.0, pytest.approx(4.0 + 5.0), 4.0, None]), ("COUNT", "BIGINT", "{IIF([v] > 4, [v], NULL)}", [1, 2, 1, None]),
    ],
)
def test_methods(spark, spells, method, kind, value, want):
    base, events = spells
    got = run_assembly(spark, [control(output_method=method, output_type=kind, measure_value=value)], base, {"events": events})
    assert {(r.uid, r.start): r.out for r in got.df.collect()} == dict(zip([(1, "2012-01-01"), (2, "2012-01-01"), (2, "2013-01-01"), (None, "2012-01-01")], want, strict=True))
    assert got.status.rows[0]["status"] == PLANNED


def test_overlapping_spells_count_twice_and_shares_are_inclusive(spark):
    base = spark.createDataFrame([(1, "2012-04-01", "2013-03-31")], "uid int, start string, stop string")
    events = spark.createDataFrame([(1, "2012-02-01", "2012-04-01", 100), (1, "2012-05-01", "2012-05-31", 1), (1, "2012-05-01", "2012-05-31", 1)], "id int, s string, e string, v int")
    got = run_assembly(spark, [control(output_method="DURATION"), control(output_name='"share"', output_method="SUM_WITHIN", output_type="FLOAT")], base, {"events": events}).df.first()
    assert got.out == 1 + 31 + 31 and got.share == pytest.approx(100 / 61 + 2)


def test_entity_constants_duplicates_and_overwriting(spark, spells):
    base, events = spells
    base = base.unionByName(base.where("uid = 1")).withColumn("out", F.lit("old"))
    got = run_assembly(spark, [control(output_name='"who"', output_method="entity", measure_value="[kind]", output_type="VARCHAR(9)", period_start='"2011-01-01"', period_end="{DATEADD(YEAR, 1, [stop])}"), control()], base, {"events": events}).df
    assert got.columns == ["uid", "start", "stop", "who__min", "who__max", "out"]
    assert Counter((r.uid, r.who__min, r.who__max, r.out) for r in got.collect()) == Counter({(1, "a", "b", 2): 2, (2, "z", "z", 2): 1, (2, "z", "z", 1): 1, (None, None, None, None): 1})


@pytest.mark.parametrize(
    "row",
    [
        {"population_uid": "uid"}, {"population_uid": '"1"'}, {"period_start": "[nope]"}, {"measure_value": "[nope]"}, {"measure_table": "[other]"}, {"output_method": "MEDIAN"},
        {"output_type": "THING"}, {"measure_value": "{[v]; DROP}"}, {"measure_value": "{FOO([v])}"}, {"output_name": None}, {"measure_start": "{([s]}"},
    ],
)
def test_assembly_validator(spark, spells, row):
    base, events = spells
    assert not validate_assembly_control_file([control(**row)], spark, base, {"events": events}).ok


def test_assembly_validator_of_files_and_columns(spark, spells, tmp_path):
    base, events = spells
    assert validate_assembly_control_file([control(ODD="x")], spark, base, {"events": events}).warnings
    assert not validate_assembly_control_file([{"population_uid": "[uid]"}], spark, base).ok
    assert not validate_assembly_control_file([control(), control()], spark, base, {"events": events}).ok
    (tmp_path / "make.sql").write_text("-- [ghost]\nSELECT id, [s], e, v INTO tmp_events FROM x\n")
    path = str(tmp_path / "make.sql")
    assert sql_file_exists_and_contains(path, "[tmp_events]") and not sql_file_exists_and_contains(path, "ghost") and not sql_file_exists_and_contains(path + "x", "v")
    named = control(measure_table="[db].[tmp_events]", measure_file="make.sql")
    assert validate_assembly_control_file([named], spark, base, sql_folder=str(tmp_path)).ok
    assert not validate_assembly_control_file([named | {"measure_value": "[missing]"}], spark, base, sql_folder=str(tmp_path)).ok


def test_overlap_join_needs_one_exchange_of_each_side(spark, spells):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        from tabloom.operators.assembly import measure_batch

        base, events = spells
        plan = measure_batch(base, events, [control()])
        text = plan._jdf.queryExecution().executedPlan().toString()
        assert text.count("Exchange hashpartitioning(uid") + text.count("Exchange hashpartitioning(muid") <= 3 and "CartesianProduct" not in text and "NestedLoop" not in text
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


# confidential


def values(spark, column, xs):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x int")
    return [r[0] for r in df.select("i", column.alias("v")).orderBy("i").select("v").collect()]


def test_random_rounding(spark):
    xs = [0, 1, 2, 3, 4, 19, 20, -1, -4, None]
    for seed in range(5):
        got = values(spark, rounding.random_rounding(F.col("x"), F.col("i") + seed * 100), xs)
        assert got[9] is None and got[0] == 0 and got[3] == 3 and all(g % 3 == 0 and abs(g - x) < 3 for g, x in zip(got[:9], xs, strict=False))
        assert values(spark, rounding.random_rounding(F.col("x"), F.col("i") + seed, 3, [6, 20]), [19, 20, 5, 6]) == [18, 21, *values(spark, rounding.random_rounding(F.col("x"), F.col("i") + seed, 3, [6, 20]), [19, 20, 5, 6])[2:]]
    many = values(spark, rounding.random_rounding(F.col("x"), F.col("i")), [1] * 6000)
    assert 0.3 < many.count(3) / 6000 < 0.37 and set(many) == {0, 3}
    with pytest.raises(ValueError):
        rounding.random_rounding(F.col("x"), F.col("i"), 3, [6, 7])


def test_graduated_and_conventional_rounding(spark):
    got = values(spark, rounding.graduated_random_rounding(F.col("x"), F.col("i"), [42]), [44, 43, 42, 41, -44])
    assert got[:3] == [45, 45, 45] and got[3] == 40 and got[4] in (-45, -40)
    for x, base in ((18, 3), (19, 2), (20, 5), (99, 5), (101, 10), (999, 10), (1001, 100), (-57, 5)):
        (g,) = values(spark, rounding.graduated_random_rounding(F.col("x"), F.col("i")), [x])
        assert g % base == 0 and abs(g - x) < base
    assert values(spark, rounding.conventional_rounding(F.col("x"), 10), [14, 15, 16, 25, 35, -15, None]) == [10, 20, 20, 20, 40, -20, None]


def test_stable_seeds_and_suppression(spark):
    seeds = values(spark, rounding.stable_seeds(F.col("x"), F.col("i"), 30), [31, 31, 30, 30, 29, 29, None])
    assert seeds[0] == seeds[1] and seeds[2] == seeds[3] and seeds[0] != seeds[2] and len({*seeds[4:]}) == 3
    assert values(spark, rounding.suppress_small(F.col("x"), F.col("x"), 3), [2, 3, None]) == [None, 3, None]
    assert values(spark, rounding.suppress_small(F.lit("t"), F.col("x"), 3, 9), [2, 3, None]) == [None, "t", "t"]
    rule = suppression_format_extract("number of businesses < 6")
    assert (rule.column, rule.threshold) == ("number.of.businesses", 6.0) and suppression_format_extract("20 > a") == suppression_format_extract("a < 20")
    for bad in ("a <= 6", "a <> 6", "a < b", "6 < a", "a > 6", ""):
        with pytest.raises(ValueError):
            suppression_format_extract(bad)


@pytest.fixture(scope="module")
def released(spark):
    return spark.createDataFrame([("a", 5, 50, None, 7), ("b", 6, None, "t", 7), ("c", 40, 41, "u", 8)], "`the label` string, n int, m int, txt string, seed int")


def test_confidential_run(released):
    got = run_confidential(
        [
            {"cmd": "RENAME", "n": "count"}, {"cmd": "MISSING_TO", "m": "9999"}, {"cmd": "DROP", "seed": "yes", "txt": "no"}, {"cmd": "SUPPRESS", "m": "count < 6", "txt": "n < 40"},
            {"cmd": "ROUND", "n": "rr3", "m": "CONV10"}, {"cmd": "SUPPRESS", "n": "6 > n"}, {"cmd": "SEED", "n": "seed"}, {"cmd": "NOTES", "n": "?"},
        ],
        released,
    )
    assert got.columns == ["the label", "count", "m", "txt", "conf_count", "conf_m", "conf_txt"]
    a, b, c = rows(got)
    assert a == ("a", 5, 50, None, None, None, None) and b[:4] == ("b", 6, 9999, "t") and b[4:] == (6, 10000.0, None) and c[4] in (39, 42) and c[5:] == (40.0, "u")
    assert rows(got) == rows(got)


@pytest.mark.parametrize(
    "row",
    [
        {"cmd": "NOPE", "n": "1"}, {"cmd": "ROUND", "n": "RR4"}, {"cmd": "ROUND", "zz": "RR3"}, {"cmd": "MISSING_TO", "n": "x"}, {"cmd": "SEED", "n": "zz"},
        {"cmd": "SUPPRESS", "n": "zz < 6"}, {"cmd": "SUPPRESS", "n": "n <= 6"},
    ],
)
def test_confidential_validator(released, row):
    assert not validate_confidential_control_file([row], released).ok
    assert validate_confidential_control_file([{"cmd": "ROUND", "n": "RR3"}], released).ok


def test_confidential_validator_of_repeats_and_thresholds(released):
    assert not validate_confidential_control_file([{"cmd": "DROP", "n": "1"}, {"cmd": "DROP", "m": "1"}], released).ok
    close = [{"cmd": "ROUND", "n": "RR3"}, {"cmd": "SUPPRESS", "n": "n < 6"}, {"cmd": "SUPPRESS", "m": "n < 7"}]
    assert not validate_confidential_control_file(close, released).ok


def test_confidential_on_a_stream(spark, released, tmp_path):
    from tabloom.streaming import confidentialise

    released.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(released.schema).parquet(str(tmp_path / "in"))
    out = confidentialise([{"cmd": "ROUND", "n": "CONV10"}, {"cmd": "SUPPRESS", "n": "n < 6"}], stream)
    query = out.writeStream.format("memory").queryName("released_stream").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert sorted(str(r.conf_n) for r in spark.table("released_stream").collect()) == ["10.0", "40.0", "None"]


# pipeline


@pytest.mark.parametrize(
    ("code", "want"),
    [
        ("a\nb\nc d", "a\nb\nc d"), ("a\n -- b \nc d", "a\n \nc d"), ("a\nb\nc /*d */e/*f\ng*/ ", "a\nb\nc e\n "), ("a\n--b", "a\n"), ("a/*b/*c*/d", "a"),
        ("a -- b /* c \n d \n e -- f */ g", "a \n d \n e "), ("a /* b /* c */ d -- e */ \n f", "a  \n f"), ("x = '--no' -- yes", "x = '--no' "),
    ],
)
def test_comments(code, want):
    assert remove_sql_comments(code) == want


def test_comments_inside_text_without_literals():
    assert remove_sql_comments("x = '--no'", literals=False) == "x = '"


def test_setvar():
    assert sql_cmd_mode_fix(':setvar a "1"\nSELECT $(a), $(b)\n  :SETVAR b x y \n') == '\nSELECT "1", x y\n\n'


@pytest.mark.parametrize(
    ("code", "want"),
    [
        ("query1\nGO\nquery2\nquery3;\nquery4\n", [("query1\n", 1, 2), ("\nquery2\nquery3", 2, 4), ("\nquery4\n", 4, 6)]),
        ("query1\n\n\nGO\n\n\nquery2\n\n", [("query1\n\n\n", 1, 4), ("\n\n\nquery2\n\n", 4, 9)]),
        ("a = ';'\nb = ';;'\n", [("a = ';'\nb = ';;'\n", 1, 3)]),
    ],
)
def test_batches(tmp_path, code, want):
    p = tmp_path / "code.sql"
    p.write_text(code)
    got = read_and_prepare_sql_code(str(p))
    expected = [(c if i < len(want) - 1 else c, s, e) for i, (c, s, e) in enumerate(want)]
    assert [(b.code.rstrip("\n"), b.start_line) for b in got] == [(c.rstrip("\n"), s) for c, s, _ in expected]


def scripts(tmp_path):
    files = {
        "setup.sql": "/* make */\nCREATE TEMP VIEW pipe_t AS SELECT 1 AS a;\nGO\nSELECT * FROM pipe_t WHERE a = $(value)\n",
        "calculate.sql": "SELECT * FROM pipe_t\n", "good.py": "assert extra == 3 and spark is not None\nprint('hello there')\n", "warn.py": "import warnings\nwarnings.warn('careful')\n",
        "bad.py": "raise RuntimeError('broken')\n", "syntax.sql": "SELEC 1\n", "notes.R": "1\n",
    }
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    return lambda *names: [{"ENABLED": "TRUE", "order": str(i), "folder": str(tmp_path), "file": n} for i, n in enumerate(names)]


def test_pipeline_runs_in_order_and_stops(spark, tmp_path):
    rows = scripts(tmp_path)("setup.sql", "good.py", "STOP IF ANY FAILURES", "calculate.sql", "bad.py", "stop if any failures", "good.py")
    for r, order in zip(rows, (None, "1", "2", "3", "4", "5", "6"), strict=True):
        r["order"] = order
    rows[0]["order"] = "0"
    log = tmp_path / "log.txt"
    status = run_pipeline(rows[::-1], spark, inject_py={"extra": 3}, inject_sql={"$(value)": "1"}, sink_file=str(log))
    got = [r["status"] for r in status.rows][::-1]
    assert got[:3] == [SUCCESS] * 3 and got[3].startswith("Stopped with error") and "lines 1" in got[3] and "broken" in got[4] and got[5].startswith("Stopped") and got[6] is None
    assert "Global message: hello there" in log.read_text()


def test_pipeline_warnings_delay_and_progress(spark, tmp_path):
    path = str(tmp_path / "warn.py")
    make = scripts(tmp_path)
    assert try_run_py_file(path)["status"] == "Stopped with warning: careful" and try_run_py_file(path, ignore_warnings=True)["status"] == SUCCESS
    assert try_run_sql_query(spark, "SELECT 1")["status"] == SUCCESS and "Stopped with error" in try_run_sql_query(spark, "SELECT nope")["status"]
    slept = []
    control = tmp_path / "control.csv"
    control.write_text(f"ENABLED,order,folder,file\nTRUE,1,{tmp_path},warn.py\nno,2,{tmp_path},bad.py\n")
    run_pipeline(str(control), spark, delay_minutes=60, ignore_warnings=True, sleep=slept.append, rng=random.Random(1))
    assert 61 * 60 <= slept[0] <= 120 * 60 and [r["status"] for r in load_control_file(str(control)).rows] == [SUCCESS, None]
    del make


def test_pipeline_validator(spark, tmp_path):
    make = scripts(tmp_path)
    assert validate_pipeline_control_file(make("calculate.sql", "good.py"), spark).ok
    for name in ("syntax.sql", "notes.R", "missing.sql"):
        assert not validate_pipeline_control_file(make(name), spark).ok
    assert not validate_pipeline_control_file([{"file": "x.sql"}], spark).ok
    assert not validate_pipeline_control_file([{"folder": str(Path(tmp_path) / "no"), "file": "x.sql"}], spark).ok
