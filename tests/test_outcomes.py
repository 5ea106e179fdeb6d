"""What written rows came to, from the one job that writes them, and runs that go on where they ended."""

from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tabloom.operators import summary
from tabloom.operators.pipeline import run_pipeline
from tabloom.operators.report import PLANNED, SUCCESS
from tabloom.operators.summary import run_summary
from tabloom.sources.controlfile import load_control_file

COLUMNS = "FILE,LABEL,GROUP,COUNT,DISTINCT,WHERE"
ROWS = ["a.csv,one,g,x,,", "a.csv,two,,x,,{x > 5}", "a.csv,three,h,x,x,", "a.csv,four,g,x,,{x < 0}", "b.csv,five,h,x,,", "b.csv,six,g,x,,", "b.csv,seven,,,x,", "b.csv,eight,h,x,,{g == 'g1'}"]
WROTE = [3, 1, 4, 0, 4, 3, 1, 4]


@pytest.fixture(scope="module")
def df(spark):
    return spark.range(600).select(F.concat(F.lit("g"), F.col("id") % 3).alias("g"), F.concat(F.lit("h"), F.floor("id") % 4).alias("h"), (F.col("id") % 50).alias("x"), F.lit("7").alias("t")).repartition(5)


def control(at: Path, rows) -> str:
    (at / "control.csv").write_text("\n".join([COLUMNS, *rows]) + "\n")
    return str(at / "control.csv")


def jobs(spark, monkeypatch, run):
    """Runs; how often lines were written."""
    seen = []
    own = summary.write_lines
    monkeypatch.setattr(summary, "write_lines", lambda f: seen.append(1) or own(f))
    return run(), len(seen)


@pytest.mark.parametrize("share", ["apart", "rollup", "sets"])
def test_rows_times_and_statuses_come_from_one_job_for_each_file(spark, df, tmp_path, monkeypatch, share):
    with pytest.warns(UserWarning, match="gave nothing: 4$"):
        got, n = jobs(spark, monkeypatch, lambda: run_summary(control(tmp_path, ROWS), df, save_folder=str(tmp_path), write=True, share=share))
    assert n == 2 and [o.rows for o in got.outcomes] == WROTE and {o.status for o in got.outcomes} == {SUCCESS}
    assert all(0 <= o.seconds < 600 for o in got.outcomes) and [o.file for o in got.outcomes] == ["a.csv"] * 4 + ["b.csv"] * 4
    for f, held in (("a.csv", WROTE[:4]), ("b.csv", WROTE[4:])):
        lines = (tmp_path / f).read_text().splitlines()
        assert len(lines) == 1 + sum(held) and lines[0] == '"label","grplabel","group","count","distinct"'
    after = load_control_file(str(tmp_path / "control.csv"))
    assert all(r["status"] == SUCCESS and r["start_time"] <= r["end_time"] for r in after.rows)


def test_nothing_to_summarise(df, tmp_path):
    with pytest.warns(UserWarning, match="gave nothing"):
        got = run_summary(control(tmp_path, ROWS), df.where("x < 0"), save_folder=str(tmp_path), write=True)
    assert [o.rows for o in got.outcomes] == [0, 1, 0, 0, 0, 0, 1, 0]
    with pytest.warns(UserWarning, match="gave nothing"):
        run_summary([{"FILE": str(tmp_path / "e.csv"), "GROUP": "g", "COUNT": "x"}], df.where("x < 0"), write=True)
    assert (tmp_path / "e.csv").read_text() == '"grplabel","group","count"\n'


def test_frames_that_nothing_ran_are_planned(df):
    got = run_summary([{"GROUP": "g", "COUNT": "x"}], df)
    assert [(o.status, o.rows, o.seconds) for o in got.outcomes] == [(PLANNED, None, None)]
    with pytest.raises(ValueError, match="resume is for"):
        run_summary([{"GROUP": "g", "COUNT": "x"}], df, resume=True)


def test_a_row_that_fails_is_found_and_a_later_run_adds_only_it(spark, df, tmp_path, monkeypatch):
    broken = df.withColumn("x", F.when((F.col("g") == "g1") & (F.col("h") == "h2"), F.raise_error(F.lit("out of order"))).otherwise(F.col("x")))
    rows = ["a.csv,one,g,h,,", "a.csv,two,g,x,,", "a.csv,three,h,g,,", "b.csv,four,g,h,,"]
    path = control(tmp_path, rows)
    got, n = jobs(spark, monkeypatch, lambda: run_summary(path, broken, save_folder=str(tmp_path), write=True))
    assert n == 1 + 3 + 1  # all together, each alone, and the other file
    assert [o.rows for o in got.outcomes] == [3, None, 4, 3] and [o.status == SUCCESS for o in got.outcomes] == [True, False, True, True]
    assert "out of order" in got.outcomes[1].status or "Stopped with error" in got.outcomes[1].status
    assert len((tmp_path / "a.csv").read_text().splitlines()) == 1 + 7
    monkeypatch.undo()
    before = (tmp_path / "a.csv").read_text()
    again, n = jobs(spark, monkeypatch, lambda: run_summary(path, df, save_folder=str(tmp_path), write=True, resume=True))
    assert n == 1 and [o.rows for o in again.outcomes] == [None, 3, None, None] and all(o.status == SUCCESS for o in again.outcomes)
    after = (tmp_path / "a.csv").read_text()
    assert after.startswith(before) and sorted(line.split(",")[0] for line in after.splitlines()[8:]) == ['"two"'] * 3
    assert (tmp_path / "b.csv").exists() and [r["status"] for r in load_control_file(path).rows] == [SUCCESS] * 4


def test_a_run_lost_between_files_goes_on_with_the_next(spark, df, tmp_path, monkeypatch):
    path = control(tmp_path, ROWS)
    own, calls = summary._write, []

    def lost(*args):
        if calls:
            raise KeyboardInterrupt
        calls.append(1)
        return own(*args)

    monkeypatch.setattr(summary, "_write", lost)
    with pytest.raises(KeyboardInterrupt):
        run_summary(path, df, save_folder=str(tmp_path), write=True)
    assert [r["status"] for r in load_control_file(path).rows] == [SUCCESS] * 4 + [PLANNED] * 4 and not (tmp_path / "b.csv").exists()
    monkeypatch.undo()
    got, n = jobs(spark, monkeypatch, lambda: run_summary(path, df, save_folder=str(tmp_path), write=True, resume=True))
    assert n == 1 and [o.rows for o in got.outcomes] == [None] * 4 + WROTE[4:]
    (tmp_path / "a.csv").unlink()  # said to be successful, but gone
    monkeypatch.undo()
    with pytest.warns(UserWarning, match="gave nothing"):
        got, n = jobs(spark, monkeypatch, lambda: run_summary(path, df, save_folder=str(tmp_path), write=True, resume=True))
    assert n == 1 and [o.rows for o in got.outcomes] == WROTE[:4] + [None] * 4


def pipeline(at: Path, files) -> str:
    """Each script adds its name to a list, in an order that is not that of the rows."""
    for f in files:
        (at / f).write_text(f"with open({str(at / 'ran.txt')!r}, 'a') as f:\n    f.write({f[0]!r})\n")
    (at / "pipeline.csv").write_text("ENABLED,ORDER,FOLDER,FILE\n" + "".join(f"TRUE,{10 - i},{at},{f}\n" for i, f in enumerate(files)) + f"FALSE,1,{at},a.py\n")
    return str(at / "pipeline.csv")


def test_scripts_go_on_from_the_first_that_was_not_successful(spark, tmp_path):
    path = pipeline(tmp_path, ["d.py", "c.py", "b.py", "a.py"])
    good = (tmp_path / "c.py").read_text()
    (tmp_path / "c.py").write_text("raise RuntimeError('not today')\n")
    first = run_pipeline(path, spark)
    ran = tmp_path / "ran.txt"
    assert ran.read_text() == "abd" and [r["status"] == SUCCESS for r in first.rows] == [True, False, True, True, False]
    (tmp_path / "c.py").write_text(good)
    log = str(tmp_path / "log.txt")
    second = run_pipeline(path, spark, resume=True, sink_file=log)
    assert ran.read_text() == "abdcd" and [r["status"] for r in second.rows] == [SUCCESS] * 4 + [None]
    assert [r["start_time"] for r in second.rows[2:4]] == [r["start_time"] for r in first.rows[2:4]] and Path(log).read_text().count("ran before") == 2
    run_pipeline(path, spark, resume=True)
    assert ran.read_text() == "abdcd"
    run_pipeline(path, spark)
    assert ran.read_text() == "abdcdabcd"


def test_a_pipeline_that_is_lost_has_its_progress(spark, tmp_path):
    path = pipeline(tmp_path, ["c.py", "b.py", "a.py"])
    run_pipeline(path, spark)
    good = (tmp_path / "b.py").read_text()
    (tmp_path / "b.py").write_text("raise KeyboardInterrupt\n")
    with pytest.raises(KeyboardInterrupt):
        run_pipeline(path, spark)
    assert [r["status"] for r in load_control_file(path).rows] == [None, None, SUCCESS, None]
    (tmp_path / "b.py").write_text(good)
    run_pipeline(path, spark, resume=True)
    assert (tmp_path / "ran.txt").read_text() == "abc" + "a" + "bc"
    rows = [{"ENABLED": "TRUE", "ORDER": "1", "FOLDER": str(tmp_path), "FILE": "a.py"}]
    assert [r["status"] for r in run_pipeline(rows, spark, resume=True).rows] == [SUCCESS]
