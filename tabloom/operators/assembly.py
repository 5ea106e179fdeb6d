"""Assembly: for each row and period of a master table, summaries of overlapping events as new columns."""

from __future__ import annotations

import os
import re
import warnings
from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.functions import tsql
from tabloom.functions.delimiters import Cell, no_obvious_escaping_injection, read_cell, remove_delimiters
from tabloom.functions.rexpr import quote
from tabloom.operators.pipeline_sql import remove_sql_comments
from tabloom.operators.report import PLANNED, SUCCESS, Report, attempt, some
from tabloom.operators.summary import _progress
from tabloom.operators.sweep import hot_uids, split, stepped, swept
from tabloom.operators.types import is_valid_data_type, spark_type, text_length
from tabloom.sources.controlfile import PROGRESS, ControlTable, as_control_table, save_control_file
from tabloom.sources.names import spare, sql2id
from tabloom.sources.paths import read_lines_utf8, save_code_to_script
from tabloom.sources.tables import Catalog, mend_table, replace_table
from tabloom.sources.work import stored

#: Methods and headers of control files.
METHODS = ("MIN", "MAX", "EXISTS", "COUNT", "MEAN", "DISTINCT", "ENTITY", "SUM", "SUM_WITHIN", "DURATION")
KEYS = ("population_uid", "period_start", "period_end", "measure_table", "measure_uid", "measure_start", "measure_end")
REQUIRED = (*KEYS, "measure_value", "output_name", "output_method", "output_type")
OPTIONAL = ("enabled", "description", "measure_file", "notes", "order", *PROGRESS)
#: Cells and the forms they take.
ACCEPTS = {
    "population_uid": ("column",), "period_start": ("column", "constant", "dynamic"), "period_end": ("column", "constant", "dynamic"),
    "measure_uid": ("column",), "measure_start": ("column", "constant", "dynamic"), "measure_end": ("column", "constant", "dynamic"),
    "measure_value": ("column", "constant", "dynamic"), "output_name": ("constant", "column"),
}


@dataclass
class AssemblyResult:
    df: DataFrame | None
    status: ControlTable


def constant(text: str) -> Column:
    """Numbers and dates by their looks, else text."""
    if re.fullmatch(r"[-+]?\d{1,18}", text):
        return F.lit(int(text))
    if re.fullmatch(r"[-+]?\d*\.\d+([eE][-+]?\d+)?", text):
        return F.lit(float(text))
    if re.fullmatch(r"\d{4}-\d{2}-\d{2}", text):
        return F.lit(text).try_cast("date")
    if re.fullmatch(r"\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}(:\d{2}(\.\d+)?)?", text):
        return F.lit(text).try_cast("timestamp")
    return F.lit(text)


def value_of(cell: Cell, df: DataFrame) -> Column:
    """A cell over a table; names are looked up without regard to case only where no exact one is there."""
    lower = {}
    for c in df.columns:
        lower.setdefault(c.lower(), c)

    def resolve(name: str) -> Column:
        at = name if name in df.columns else lower.get(name.lower())
        if at is None:
            raise ValueError(f"no column {name}")
        return F.col(quote(at))

    if cell.kind == "constant":
        return constant(cell.text)
    return resolve(cell.text) if cell.kind == "column" else tsql.to_column(cell.text, resolve, lambda c: df.select(c).schema[0].dataType.simpleString())


def moments(*sides: tuple[DataFrame, Column]) -> str:
    """The type in which times are compared: dates, unless a side has times of day (a date then is its midnight)."""
    return "timestamp" if any(df.select(c).schema[0].dataType.simpleString().startswith("timestamp") for df, c in sides) else "date"


def entity_rows(rows: list[dict]) -> list[dict]:
    """An ENTITY row gives its smallest and its largest value in two columns."""
    out = []
    for r in rows:
        if str(r["output_method"]).strip().upper() != "ENTITY":
            out.append(r)
            continue
        name = output_name(r)
        out += [{**r, "output_method": "MIN", "output_name": f'"{name}__min"'}, {**r, "output_method": "MAX", "output_name": f'"{name}__max"'}]
    return out


def output_name(row: dict) -> str:
    text = str(row["output_name"])
    for d in ("[]", '"', "'"):
        text = remove_delimiters(text, d)
    return text


def method(name: str, v: Column, ps: Column, pe: Column, ms: Column, me: Column) -> Column:
    """An output method over events that overlap the period; days count inclusively."""
    overlap = F.datediff(F.least(pe, me), F.greatest(ps, ms)) + 1
    length = F.datediff(me, ms) + 1
    return {
        "MIN": lambda: F.min(v),
        "MAX": lambda: F.max(v),
        "EXISTS": lambda: F.when(F.count(v) >= 1, F.lit(1)),
        "COUNT": lambda: F.count(v),
        "MEAN": lambda: F.avg(v),
        "DISTINCT": lambda: F.count_distinct(v),
        "SUM": lambda: F.sum(v),
        "SUM_WITHIN": lambda: F.sum(overlap.cast("double") / F.nullif(length, F.lit(0)) * v),
        "DURATION": lambda: F.sum(F.when(v.isNotNull(), overlap)),
    }[name.strip().upper()]()


def cast_output(x: Column, kind: str) -> Column:
    out = x.try_cast(spark_type(kind))
    n = text_length(kind)
    out = F.substring(out, 1, n) if n else out
    return F.when(out != 0, F.lit(1)).when(out == 0, F.lit(0)) if re.search(r"\bBIT\b", kind.upper()) else out


def measure_batch(master: DataFrame, measure: DataFrame, rows: list[dict], sweep: int | None = None) -> DataFrame:
    """uid, ps, pe and out0, out1, ... for the rows, for each uid and period that events overlap.

    Periods are distinct before they meet events. The join is by uid, with the
    overlap as a residual; grouping by uid and period needs no further exchange.
    With ``sweep``, uids of more than so many events are summed by blocks of time,
    and DISTINCT of the others counts steps, as groups of values would be all pairs.
    """
    keys, events, kind = _sides(master, measure, rows)
    methods = {i: str(r["output_method"]) for i, r in enumerate(rows)}
    outs = [F.col(f"out{i}") for i in methods]
    if sweep is None:
        found = _joined(keys, events, methods)
    else:
        hot = hot_uids(events, sweep)
        (hot_keys, cold_keys), (hot_events, cold_events) = split(keys, "uid", hot), split(events, "muid", hot)
        parts = [swept(hot_keys, hot_events, methods, kind)]
        if others := {i: m for i, m in methods.items() if m.strip().upper() != "DISTINCT"}:
            parts.append(_joined(cold_keys, cold_events, others))
        parts += [stepped(cold_keys, cold_events, i, kind) for i in methods if i not in others]
        every = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts)
        # a period has one row of each part at most
        found = every.groupBy("uid", "ps", "pe").agg(*(F.first(f"out{i}", ignorenulls=True).alias(f"out{i}") for i in methods)) if len(parts) > 2 else every
    return found.select("uid", "ps", "pe", *(cast_output(o, str(r["output_type"])).alias(f"out{i}") for i, (o, r) in enumerate(zip(outs, rows, strict=True))))


def _sides(master: DataFrame, measure: DataFrame, rows: list[dict]) -> tuple[DataFrame, DataFrame, str]:
    """Distinct uid, ps, pe of the master; muid, ms, me, v0, v1, ... of the events; the type of the times."""
    first = rows[0]
    cell = {k: read_cell(str(first[k])) for k in KEYS if k != "measure_table"}
    period = [value_of(cell[k], master) for k in ("period_start", "period_end")]
    spell = [value_of(cell[k], measure) for k in ("measure_start", "measure_end")]
    kind = moments(*((master, c) for c in period), *((measure, c) for c in spell))
    keys = master.select(value_of(cell["population_uid"], master).alias("uid"), *(c.try_cast(kind).alias(n) for c, n in zip(period, ("ps", "pe"), strict=True))).distinct()
    events = measure.select(
        value_of(cell["measure_uid"], measure).alias("muid"),
        *(c.try_cast(kind).alias(n) for c, n in zip(spell, ("ms", "me"), strict=True)),
        *(value_of(read_cell(str(r["measure_value"])), measure).alias(f"v{i}") for i, r in enumerate(rows)),
    )
    return keys, events, kind


def _joined(keys: DataFrame, events: DataFrame, methods: Mapping[int, str]) -> DataFrame:
    kinds = dict(keys.dtypes)["uid"], dict(events.dtypes)["muid"]
    same = F.col("uid") == F.col("muid")
    if "string" in kinds and kinds[0] != kinds[1]:
        same = F.col("uid").cast("string") == F.col("muid").cast("string")
    met = keys.join(events, same & (F.col("ps") <= F.col("me")) & (F.col("ms") <= F.col("pe")))
    when = [F.col(c) for c in ("ps", "pe", "ms", "me")]
    return met.groupBy("uid", "ps", "pe").agg(*(method(m, F.col(f"v{i}"), *when).alias(f"out{i}") for i, m in methods.items()))


def unreadable(df: DataFrame, row: dict, which: tuple[str, ...], kind: str) -> dict[str, int]:
    """How many values of each cell that is text are no times; one pass, and none where no cell is text."""
    cells = {c: value_of(read_cell(str(row[c])), df) for c in which}
    text = {c: v for c, v in cells.items() if df.select(v).schema[0].dataType.simpleString() == "string"}
    if not text:
        return {}
    counted = df.agg(*(F.count_if(v.isNotNull() & v.try_cast(kind).isNull()).alias(c) for c, v in text.items())).first()
    return {c: counted[c] for c in text if counted[c]}


def attach(master: DataFrame, done: list[tuple[list[dict], DataFrame]]) -> DataFrame:
    """The master with the outputs of all batches as last columns; rows without events get none, and columns of these names give way.

    Batches with the same master keys become one table, a row for each key, so the
    master is joined once for all of them, whatever names its columns have.
    """
    groups: dict[tuple, list[tuple[list[dict], DataFrame]]] = {}
    for rows, setup in done:
        groups.setdefault((*(str(rows[0][k]) for k in KEYS[:3]), dict(setup.dtypes)["ps"]), []).append((rows, setup))
    names = [output_name(r) for rows, _ in done for r in rows]
    held = spare([*master.columns, *names], *(f"new{i}" for i in range(len(names))), "uid", "ps", "pe", "of_uid", "of_ps", "of_pe")
    own, new = held[-6:], dict(zip(names, held, strict=False))
    out = master
    for (*cells, kind), batch in groups.items():
        values = [value_of(read_cell(c), master) for c in cells]
        keyed = out.withColumns({own[0]: values[0], own[1]: values[1].try_cast(kind), own[2]: values[2].try_cast(kind)})
        right = [setup.select(*(F.col(c).alias(o) for c, o in zip(("uid", "ps", "pe"), own[3:], strict=True)), *(F.col(f"out{i}").alias(new[output_name(r)]) for i, r in enumerate(rows))) for rows, setup in batch]
        one = right[0]
        if len(right) > 1:  # a key has one row of each batch at most
            every = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), right)
            one = every.groupBy(*own[3:]).agg(*(F.first(c, ignorenulls=True).alias(c) for c in every.columns if c not in own))
        on = reduce(lambda x, y: x & y, (F.col(a) == F.col(b) for a, b in zip(own[:3], own[3:], strict=True)))
        out = keyed.join(one, on, "left").drop(*own)
    kept = [c for c in master.columns if c not in names]
    return out.select(*(F.col(quote(c)) for c in kept), *(F.col(new[n]).alias(n) for n in names))


def _reads(row: dict) -> set[str]:
    """Columns of the master that a batch's keys read, in lower case."""
    out = set()
    for k in KEYS[:3]:
        cell = read_cell(str(row[k]))
        out |= {cell.text} if cell.kind == "column" else tsql.columns_read(cell.text) if cell.kind == "dynamic" else set()
    return {c.lower() for c in out}


def batches(rows: list[dict]) -> list[list[dict]]:
    """Rows that share master keys and measure keys are one query."""
    out: dict[tuple, list[dict]] = {}
    for r in rows:
        out.setdefault(tuple(str(r[k]) for k in KEYS), []).append(r)
    return list(out.values())


def sql_file_exists_and_contains(path: str, text: str) -> bool:
    """A .sql file whose code, comments aside, has the text, with or without brackets."""
    if not str(path).lower().endswith(".sql") or not os.path.exists(path):
        return False
    code = remove_sql_comments("\n".join(read_lines_utf8(path)))
    plain = lambda s: re.sub(r"[\[\]]", "", s).lower()
    return plain(text) in plain(code)


def validate_assembly_control_file(control, spark: SparkSession, master: DataFrame | str, measures: Mapping[str, DataFrame] | None = None, sheet: str | None = None, sql_folder: str | None = None) -> Report:
    """Checks of the text and of the schemas; nothing runs."""
    report = Report()
    table = as_control_table(control, sheet).lower()
    missing = [c for c in REQUIRED if c not in table.columns]
    if not report.check(not missing, f"missing columns: {some(missing, 99)}"):
        return report
    extra = [c for c in table.columns if c not in (*REQUIRED, *OPTIONAL)]
    report.check(not extra, f"columns that are not used: {some(extra)}", warn=True)
    catalog = Catalog(spark, measures)
    base = catalog.find(master) if isinstance(master, str) else master
    report.check(base is not None, f"no master table {master}")
    rows = table.enabled().rows
    names = []
    for r in rows:
        empty = [c for c in REQUIRED if r[c] is None]
        if not report.check(not empty, f"empty cells: {some(empty)}"):
            continue
        cells = {}
        for c, kinds in ACCEPTS.items():
            text = str(r[c])
            cell = cells[c] = read_cell(text, bare="none")
            report.check(cell.kind in kinds, f"{c}: {text} is not delimited as {' or '.join(kinds)}")
            report.check(no_obvious_escaping_injection(remove_delimiters(text, "{}")), f"{c}: {text} has unpaired quotes or brackets, or ; or braces")
        report.check(str(r["output_method"]).strip().upper() in METHODS, f"unknown output_method {r['output_method']}")
        report.check(is_valid_data_type(str(r["output_type"])), f"unknown output_type {r['output_type']}")
        names.append(output_name(r).lower())
        if report.problems:
            continue
        if base is not None:
            _columns(report, r, cells, ("population_uid", "period_start", "period_end"), base, "master")
        measure = catalog.find(str(r["measure_table"]))
        if measure is not None:
            _columns(report, r, cells, ("measure_uid", "measure_start", "measure_end", "measure_value"), measure, str(r["measure_table"]))
        else:
            path = os.path.join(sql_folder or "", str(r.get("measure_file") or ""))
            found = bool(r.get("measure_file")) and sql_file_exists_and_contains(path, sql2id(str(r["measure_table"]))[-1])
            report.check(found, f"no table {r['measure_table']}, and no SQL file that makes it")
            for c in ("measure_uid", "measure_start", "measure_end", "measure_value") if found else ():
                if cells[c].kind == "column":
                    report.check(sql_file_exists_and_contains(path, cells[c].text), f"{path} has no {cells[c].text}")
    twice = {n for n in names if names.count(n) > 1}
    report.check(not twice, f"output names that repeat: {some(twice)}")
    return report


def _columns(report: Report, row: dict, cells: dict[str, Cell], which, df: DataFrame, where: str) -> None:
    for c in which:
        try:
            df.select(value_of(cells[c], df))
        except Exception as e:
            report.check(False, f"{c}: {row[c]} in {where}: {str(e).splitlines()[0]}")


def run_assembly(
    spark: SparkSession,
    control,
    master: DataFrame | str,
    measures: Mapping[str, DataFrame] | None = None,
    sheet: str | None = None,
    sql_folder: str | None = None,
    debug_folder: str | None = None,
    execute: bool | None = None,
    sweep: int | None = None,
    write_to: str | None = None,
) -> AssemblyResult:
    """A new master table, with a column for each enabled row, and the status of each row.

    With ``execute`` (and for a control file given by path, which gets the status
    written back) each batch runs and is stored, so that its status is what came
    of it; a batch that fails leaves the master as it was, and the others go on;
    times that can't be read are counted, and warned of.
    With ``sweep``, uids of more than so many events are summed by blocks of time
    instead of meeting each period in pairs.
    With ``write_to``, the name of the master's table in the catalog, each batch
    runs too and that table gets the new columns, in place (``sources.tables.replace_table``).
    Otherwise the result is one plan, and rows that compile are said to be planned.
    With all rows off there is a warning and no result.
    """
    if write_to:
        mend_table(spark, write_to)
    validate_assembly_control_file(control, spark, master, measures, sheet, sql_folder).require()
    full = as_control_table(control, sheet)
    table = full.lower().without(PROGRESS)
    catalog = Catalog(spark, measures)
    df = catalog.get(master) if isinstance(master, str) else master
    on = table.enabled()
    if not on.rows:
        warnings.warn("all rows of the control file are off", stacklevel=2)
        return AssemblyResult(None, full)
    by_path = isinstance(control, (str, os.PathLike))
    execute = (by_path if execute is None else execute) or bool(write_to)
    done: dict[tuple, dict] = {}
    waiting: list[tuple[list[dict], DataFrame]] = []
    for rows in batches(entity_rows(on.rows)):
        if waiting and _reads(rows[0]) & {output_name(r).lower() for w, _ in waiting for r in w}:
            df, waiting = attach(df, waiting), []  # these keys are outputs of batches before

        def go(rows=rows, df=df):
            measure = catalog.get(str(rows[0]["measure_table"]))
            setup = measure_batch(df, measure, rows, sweep)
            out = attach(df, [(rows, setup)])
            if debug_folder:
                save_code_to_script(out._jdf.queryExecution().toString(), f"assembly {output_name(rows[0])}", debug_folder)
            if not execute:
                return setup
            kind = dict(setup.dtypes)["ps"]
            for where, side, which in (("the master", df, ("period_start", "period_end")), (str(rows[0]["measure_table"]), measure, ("measure_start", "measure_end"))):
                for c, n in unreadable(side, rows[0], which, kind).items():
                    warnings.warn(f"{n} values of {c} {rows[0][c]} in {where} are no times, and meet nothing", stacklevel=2)
            return stored(setup, "assembly")

        got = attempt(go)
        if got["result"] is not None:
            waiting.append((rows, got["result"]))
        got["status"] = PLANNED if got["status"] == SUCCESS and not execute else got["status"]
        done[tuple(str(rows[0][k]) for k in KEYS)] = got
    df = attach(df, waiting) if waiting else df
    if write_to and any(d["result"] is not None for d in done.values()):
        df = replace_table(spark, write_to, df)
    progress = ControlTable([*on.columns, *PROGRESS], [{**r, **{p: done[tuple(str(r[k]) for k in KEYS)][p] for p in PROGRESS}} for r in on.rows])
    status = _progress(full, table, progress)
    if by_path:
        save_control_file(str(control), status, sheet)
    return AssemblyResult(df, status)


__all__ = ["AssemblyResult", "run_assembly", "validate_assembly_control_file"]
