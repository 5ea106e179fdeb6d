"""Pipeline: SQL and Python scripts in order, unattended, with their status."""

from __future__ import annotations

import contextlib
import io
import os
import random
import runpy
import time
import warnings
from pathlib import Path

from pyspark.sql import SparkSession

from tabloom.operators.pipeline_sql import read_and_prepare_sql_code
from tabloom.operators.report import SUCCESS, Report, attempt, first_line, now, some
from tabloom.operators.sql_script import SqlScript
from tabloom.operators.summary import _earlier, _progress
from tabloom.sources.controlfile import PROGRESS, ControlTable, as_control_table, save_control_file
from tabloom.sources.paths import adjust_file_path_handling, run_time_inform_user

STOP = "STOP IF ANY FAILURES"


class ScriptError(RuntimeError):
    """A batch of a script failed; the message has its lines."""


def try_run_sql_query(spark: SparkSession, query: str) -> dict:
    """Run, with no row for the driver."""
    return _status(attempt(lambda: spark.sql(query).write.format("noop").mode("overwrite").save()))


def _status(got: dict) -> dict:
    return {k: got[k] for k in ("status", "start_time", "end_time")}


@contextlib.contextmanager
def _warnings(ignore: bool, kind: type[Warning] = Warning):
    """Warnings stop what runs; those ignored go to whoever records them."""
    if ignore:
        yield
        return
    with warnings.catch_warnings():
        warnings.simplefilter("error", kind)
        yield


def try_run_sql_file(spark: SparkSession, path: str, inject: dict[str, str] | None = None, ignore_warnings: bool = False) -> dict:
    """All batches in a session of their own; the first error ends the file, and its own tables go with it."""

    def go() -> bool:
        script = SqlScript(spark)
        try:
            for batch in read_and_prepare_sql_code(path, inject):
                if batch.code.strip():
                    try:
                        with _warnings(ignore_warnings, UserWarning):
                            script.run(batch.code)
                    except Exception as e:
                        kind = type(e) if isinstance(e, Warning) else ScriptError
                        raise kind(f"lines {batch.start_line} to {batch.end_line}: {first_line(e)}") from e
        finally:
            script.close()
        return True

    return _status(attempt(go))


def try_run_py_file(path: str, inject: dict | None = None, ignore_warnings: bool = False) -> dict:
    """In a namespace of its own that has the injected values; a warning ends the file unless ignored."""

    def go() -> bool:
        with _warnings(ignore_warnings):
            runpy.run_path(path, init_globals=dict(inject or {}), run_name="__main__")
        return True

    return _status(attempt(go))


def sql_parses(spark: SparkSession, code: str) -> str | None:
    """The parser's complaint, or None; tables need not exist."""
    try:
        for text in SqlScript(spark).texts(code):
            spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    except Exception as e:
        return first_line(e)
    return None


def run_order(rows: list[dict]) -> list[int]:
    """Places of rows by order; those without one last, ties as they stand."""
    return sorted(range(len(rows)), key=lambda i: (rows[i].get("order") is None, rows[i].get("order") or 0))


def _is_stop(row: dict) -> bool:
    return str(row.get("file") or "").strip().upper() == STOP


def _path(row: dict) -> str:
    return os.path.join(adjust_file_path_handling(str(row.get("folder") or "")), str(row.get("file") or ""))


def validate_pipeline_control_file(control, spark: SparkSession, sheet: str | None = None, inject_sql: dict[str, str] | None = None) -> Report:
    report = Report()
    names = [n.lower() for n in inject_sql or {}]
    report.check(len(set(names)) == len(names), f"injected names that repeat: {some({n for n in names if names.count(n) > 1})}")
    table = as_control_table(control, sheet).lower()
    missing = [c for c in ("folder", "file") if c not in table.columns]
    if not report.check(not missing, f"missing columns: {some(missing)}"):
        return report
    extra = [c for c in table.columns if c not in ("enabled", "order", "folder", "file", "notes", "description", *PROGRESS)]
    report.check(not extra, f"columns that are not used: {some(extra)}", warn=True)
    for row in table.enabled().rows:
        if _is_stop(row):
            continue
        path = _path(row)
        kind = Path(path).suffix.lower()
        if not report.check(kind in (".sql", ".py"), f"{row['file']}: only .sql and .py scripts run"):
            continue
        if not report.check(os.path.isdir(os.path.dirname(path)), f"no folder {os.path.dirname(path)}") or not report.check(os.path.isfile(path), f"no file {path}"):
            continue
        if kind == ".sql":
            try:
                found = read_and_prepare_sql_code(path, inject_sql)
            except ValueError as e:
                report.check(False, str(e))
                continue
            for batch in found:
                why = sql_parses(spark, batch.code) if batch.code.strip() else None
                report.check(why is None, f"{row['file']}, lines {batch.start_line} to {batch.end_line}: {why}")
    return report


def run_pipeline(
    control,
    spark: SparkSession,
    sheet: str | None = None,
    delay_minutes: float = 0,
    inject_py: dict | None = None,
    inject_sql: dict[str, str] | None = None,
    ignore_warnings: bool = False,
    sink_file: str | None = None,
    sleep=time.sleep,
    rng: random.Random | None = None,
    resume: bool = False,
) -> ControlTable:
    """Runs each enabled script; a stop row ends the run when any before it failed.

    A delay of an hour or more is lengthened by a random part of an hour, so that
    runs set up together do not start together. Rows not reached have no status.
    A control file given by path gets the progress after each script, so that a run
    that is lost can go on: with ``resume`` rows that it says were successful are left
    as they are up to the first, in the order of running, that was not; from there on
    all run, as a script may need what one before it makes. What scripts keep in
    their session only, such as views, is not there for those that run later.
    """
    validate_pipeline_control_file(control, spark, sheet, inject_sql).require()
    full = as_control_table(control, sheet)
    table = full.lower().without(PROGRESS)
    on = table.enabled()
    if delay_minutes > 0:
        extra = (rng or random.Random()).randint(1, 60) if delay_minutes >= 60 else 0
        run_time_inform_user(f"starts in {delay_minutes + extra:g} minutes", sink_file)
        sleep((delay_minutes + extra) * 60)
    done = [dict.fromkeys(PROGRESS) for _ in on.rows]
    before, order = _earlier(full, table), run_order(on.rows)
    kept = next((n for n, i in enumerate(order) if not before[i]), len(order)) if resume else 0
    for i in order[:kept]:
        done[i] = before[i]
        run_time_inform_user(f"{on.rows[i]['file']}: ran before", sink_file)

    def status() -> ControlTable:
        progress = ControlTable([*on.columns, *PROGRESS], [{**r, **{p: d[p] for p in PROGRESS}} for r, d in zip(on.rows, done, strict=True)])
        out = _progress(full, table, progress)
        if isinstance(control, (str, os.PathLike)):
            save_control_file(str(control), out, sheet)
        return out

    if isinstance(control, (str, os.PathLike)):
        status()  # what an earlier run said of rows that run now is no longer so
    ran = []
    for i in order[kept:]:
        row = on.rows[i]
        if _is_stop(row):
            failed = [j for j in ran if done[j]["status"] != SUCCESS]
            done[i] = {"start_time": now(), "end_time": now(), "status": "Stopped: earlier failures" if failed else SUCCESS}
            if failed:
                run_time_inform_user("stopped after failures", sink_file)
                break
            continue
        ran.append(i)
        path = _path(row)
        said = io.StringIO()
        with contextlib.redirect_stdout(said), warnings.catch_warnings(record=True) as warned:
            warnings.simplefilter("always")
            if path.lower().endswith(".sql"):
                done[i] = try_run_sql_file(spark, path, inject_sql, ignore_warnings)
            else:
                done[i] = try_run_py_file(path, {"spark": spark} | (inject_py or {}), ignore_warnings)
        for line in said.getvalue().splitlines():
            run_time_inform_user(f"Global message: {line}", sink_file)
        for w in warned:
            run_time_inform_user(f"Global warning: {w.message}", sink_file)
        if done[i]["status"].startswith("Stopped with error"):
            run_time_inform_user(f"Global error: {done[i]['status'].partition(': ')[2]}", sink_file)
        run_time_inform_user(f"{row['file']}: {done[i]['status']}", sink_file)
        if isinstance(control, (str, os.PathLike)):
            status()
    return status()
