"""Summary: each control row filters, groups and aggregates; all results are stacked."""

from __future__ import annotations

import os
import time
import warnings
from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.functions import rexpr
from tabloom.functions.delimiters import Cell, is_delimited, no_obvious_escaping_injection, read_cell, remove_delimiters
from tabloom.functions.parse import ExpressionError
from tabloom.functions.rexpr import quote
from tabloom.operators.report import PLANNED, SUCCESS, Report, attempt, some
from tabloom.plans.combos import tolower_control_file_cells
from tabloom.plans.shared import MODES, PARTS, SharedRow, shared
from tabloom.sources import files as files_
from tabloom.sources.controlfile import PROGRESS, ControlTable, as_control_table, keyword, merge_progress, save_control_file
from tabloom.sources.names import tolower_colnames
from tabloom.sources.paths import save_code_to_script
from tabloom.sources.sinks import join_lines, write_lines

AGGREGATES = ("distinct", "count", "sum", "stddev", "max", "min", "entity", "seed")
KNOWN = {"enabled", "file", "label", "group", "where", "notes", "note", *AGGREGATES, *PROGRESS, "order"}


@dataclass
class SummarySpec:
    """One control row, compiled from text."""

    labels: dict[str, str] = field(default_factory=dict)
    groups: dict[str, str] = field(default_factory=dict)  #: header to column
    aggregates: dict[str, Cell] = field(default_factory=dict)
    where: list[str] = field(default_factory=list)
    file: str | None = None


@dataclass
class Outcome:
    """What came of an enabled control row."""

    row: int  #: its place among the enabled rows, from 0
    file: str | None
    status: str
    rows: int | None = None  #: that it wrote; None where it did not run
    seconds: float | None = None  #: until its last row was made; until the end, where it gave none


@dataclass
class SummaryResult:
    df: DataFrame | None
    status: ControlTable
    files: dict[str, DataFrame] = field(default_factory=dict)
    outcomes: list[Outcome] = field(default_factory=list)


def read_spec(row: dict) -> SummarySpec:
    spec = SummarySpec(file=row.get("file"))
    for header, cell in row.items():
        kind = keyword(header)
        if cell is None:
            continue
        if kind == "label":
            spec.labels[header] = str(cell)
        elif kind == "group":
            spec.groups[header] = remove_delimiters(cell, "[]")
        elif kind == "where":
            spec.where.append(remove_delimiters(cell, "{}"))
        elif kind in AGGREGATES:
            spec.aggregates[header] = read_cell(cell)
    return spec


def entity_parts(name: str, columns: Sequence[str]) -> list[str]:
    """The columns that hold an entity: itself, or its min and max."""
    return [name] if name in columns else [c for c in (f"{name}__min", f"{name}__max") if c in columns]


def entity_union(df: DataFrame, entities: Sequence[str], groups: Sequence[str], read: Sequence[str]) -> DataFrame:
    """Two rows for each one, in one scan: the first with each entity's min, the second with its max and all but groups missing."""
    paired = [e for e in entities if e not in df.columns]
    if not paired:
        return df
    used = {c for e in paired for c in (f"{e}__min", f"{e}__max")}
    if clash := set(groups) & set(read):
        raise ValueError(f"columns both grouped and summarised beside an entity of two columns: {some(clash)}")
    types = dict(df.dtypes)
    keep = [c for c in df.columns if c not in used]

    def half(suffix: str) -> Column:
        values = []
        for c in keep:
            own = F.col(quote(c))
            values.append((own if suffix == "min" or c in groups else F.lit(None).cast(types[c])).alias(c))
        for e in paired:
            name = f"{e}__{suffix}"
            kind = types.get(f"{e}__min") or types[f"{e}__max"]
            values.append((F.col(quote(name)).cast(kind) if name in types else F.lit(None).cast(kind)).alias(e))
        return F.struct(*values)

    return df.select(F.inline(F.array(half("min"), half("max"))))


def _value(cell: Cell, names: dict[str, str]) -> Column:
    if cell.kind == "dynamic":
        return rexpr.to_column(cell.text, names)
    if cell.kind == "constant":
        return F.lit(cell.text)
    if cell.text not in names:
        raise ExpressionError(f"unknown column {cell.text!r}")
    return F.col(quote(cell.text))


def aggregate(kind: str, x: Column, null_mode: str = "local") -> Column:
    """null_mode "local": the sum of nothing is 0; "sql": missing."""
    zero = (lambda c: F.coalesce(c, F.lit(0))) if null_mode == "local" else (lambda c: c)
    return {
        "distinct": lambda: F.count_distinct(x),
        "count": lambda: F.count(x),
        "sum": lambda: zero(F.sum(x)),
        "entity": lambda: F.nullif(F.count_distinct(x), F.lit(0)),
        "stddev": lambda: F.stddev_samp(x),
        "max": lambda: F.max(x),
        "min": lambda: F.min(x),
        "seed": lambda: zero(F.sum(F.pmod(x, F.lit(100)))),
    }[kind]()


def as_text(x: Column, kind: str) -> Column:
    """Whole numbers without decimals or exponent, truth values in capitals."""
    if kind == "boolean":
        return F.when(x, "TRUE").when(~x, "FALSE")
    if kind in ("double", "float"):
        x = x.cast("double")
        whole = (x == F.rint(x)) & (F.abs(x) < 1e15)
        return F.when(whole, F.when(whole, x).cast("long").cast("string")).otherwise(x.cast("string"))
    return x.cast("string")


def output_columns(columns: Sequence[str]) -> list[str]:
    """Headers that give output, in their order; a group's name goes before its value."""
    out = []
    for c in columns:
        kind = keyword(c)
        if kind == "group":
            out += [f"grplabel{c[len('group'):]}", c]
        elif kind == "label" or kind in AGGREGATES:
            out.append(c)
    return out


def bitmap_counts(df: DataFrame, keys: dict[str, Column], value: Column, name: str) -> DataFrame:
    """Distinct whole numbers of each group, by bitmaps of 32,768 numbers: a bit for each, put together before and after the exchange.

    A value that comes a million times is one bit, and dense numbers take a bit of
    the exchange where a set of them takes a row each.
    """
    held = df.where(value.isNotNull()).select(*(c.alias(k) for k, c in keys.items()), F.bitmap_bucket_number(value).alias("bucket"), F.bitmap_bit_position(value).alias("bit"))
    maps = held.groupBy(*keys, "bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))
    return maps.groupBy(*keys).agg(F.sum(F.bitmap_count("bits")).alias(name))


def _with_bitmaps(df: DataFrame, keys: dict[str, Column], cells: dict[str, tuple[str, Column]], null_mode: str) -> DataFrame:
    """All aggregates of a row, where distinct counts of whole numbers are of bitmaps and need no copies of rows."""
    whole = {h for h, (kind, x) in cells.items() if kind in ("distinct", "entity") and df.select(x).schema[0].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")}
    rest = [aggregate(kind, x, null_mode).alias(h) for h, (kind, x) in cells.items() if h not in whole] or [F.count("*").alias("_rows")]
    base = df.groupBy(*(c.alias(k) for k, c in keys.items())).agg(*rest) if keys else df.agg(*rest).withColumn("_all", F.lit(0))
    by = keys or {"_all": F.lit(0)}  # of the whole table there is one row, whatever the bitmaps have
    for i, h in enumerate(h for h in cells if h in whole):
        right = bitmap_counts(df, by, cells[h][1], f"_n{i}").withColumnsRenamed({k: f"_of{k}" for k in by})
        same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_of{k}")) for k in by))
        count = F.coalesce(f"_n{i}", F.lit(0).cast("long"))
        base = base.join(right, same, "left").withColumn(h, F.nullif(count, F.lit(0)) if cells[h][0] == "entity" else count).drop(*right.columns)
    return base


def compile_row(spec: SummarySpec, df: DataFrame, remove_na_from_groups: bool = True, entity_where: str = "before_union", null_mode: str = "local", distinct: str = "sets") -> DataFrame:
    """The row's own result: labels, group names and values as text, then its aggregates."""
    names = df.columns
    entities = [c.text for h, c in spec.aggregates.items() if keyword(h) == "entity" and c.kind == "column" and c.text not in names]
    for e in entities:
        if not entity_parts(e, names):
            raise ExpressionError(f"unknown entity {e!r}")
    if remove_na_from_groups and spec.groups:
        df = df.dropna("any", subset=[quote(g) for g in dict.fromkeys(spec.groups.values())])
    if entity_where == "before_union":
        for w in spec.where:
            df = df.where(rexpr.to_column(w, dict(df.dtypes)))
    if entities:
        read = set().union(*(rexpr.columns_read(c.text) if c.kind == "dynamic" else {c.text} for h, c in spec.aggregates.items() if c.text not in entities), set())
        df = entity_union(df, entities, list(spec.groups.values()), sorted(read))
    if entity_where == "after_union":
        for w in spec.where:
            df = df.where(rexpr.to_column(w, dict(df.dtypes)))
    kinds = dict(df.dtypes)
    aggs = [aggregate(keyword(h), _value(c, kinds), null_mode).alias(h) for h, c in spec.aggregates.items()]
    keys = {f"_g{i}": g for i, g in enumerate(dict.fromkeys(spec.groups.values()))}
    by = {g: k for k, g in keys.items()}
    if distinct == "bitmaps":
        cells = {h: (keyword(h), _value(c, kinds)) for h, c in spec.aggregates.items()}
        grouped = _with_bitmaps(df, {k: F.col(quote(g)) for k, g in keys.items()}, cells, null_mode)
    else:
        grouped = df.groupBy(*(F.col(quote(g)).alias(k) for k, g in keys.items())).agg(*aggs) if keys else df.agg(*aggs)
    shown = [F.lit(v).alias(h) for h, v in spec.labels.items()]
    for h, g in spec.groups.items():
        shown += [F.lit(g).alias(f"grplabel{h[len('group'):]}"), as_text(F.col(by[g]), kinds[g]).alias(h)]
    return grouped.select(*shown, *(F.col(quote(h)) for h in spec.aggregates))


def _common(kinds: set[str]) -> str:
    kinds -= {"void"}
    if not kinds:
        return "string"
    if len(kinds) == 1:
        return kinds.pop()
    whole = {"tinyint", "smallint", "int", "bigint"}
    if kinds <= whole:
        return "bigint"
    if all(k in whole or k in ("double", "float") or k.startswith("decimal") for k in kinds):
        return "double"
    return "string"


def _types(frames: Sequence[DataFrame], columns: Sequence[str]) -> dict[str, str]:
    kinds = {c: set() for c in columns}
    for df in frames:
        for c, k in df.dtypes:
            kinds[c].add(k)
    return {c: _common(k) for c, k in kinds.items()}


def _shaped(c: str, value: Column | None, kind: str | None, to: str) -> Column:
    """An output of type ``kind`` as the column's own type; missing where a row has none."""
    if value is None:
        return F.lit(None).cast(to).alias(c)
    return (as_text(value, kind) if to == "string" else value).cast(to).alias(c)


def stack(frames: Sequence[DataFrame], columns: Sequence[str], types: dict[str, str] | None = None) -> DataFrame:
    """All results in one plan; columns that a row lacks are missing in it."""
    types = types or _types(frames, columns)

    def shaped(df: DataFrame) -> DataFrame:
        has = dict(df.dtypes)
        return df.select(*(_shaped(c, F.col(quote(c)) if c in has else None, has.get(c), types[c]) for c in columns))

    return reduce(DataFrame.unionByName, map(shaped, frames))


def can_share(spec: SummarySpec, names: Sequence[str]) -> bool:
    """Whether all of a row's aggregates can be made of parts."""
    kinds = [keyword(h) for h in spec.aggregates]
    return bool(kinds) and all(k in PARTS for k in kinds)


def _shared_row(spec: SummarySpec, df: DataFrame, own: DataFrame, columns: Sequence[str], types: dict[str, str], null_mode: str) -> SharedRow:
    kinds, has = dict(df.dtypes), dict(own.dtypes)
    tests = [rexpr.to_column(w, kinds) for w in spec.where]
    headers = {f"grplabel{h[len('group'):]}": F.lit(g) for h, g in spec.groups.items()} | {h: F.lit(v) for h, v in spec.labels.items()}

    def output(groups: dict[str, Column], found: dict[str, Column]) -> list[Column]:
        values = dict(headers)
        values |= {h: as_text(groups[g], kinds[g]) for h, g in spec.groups.items()}
        for h, c in found.items():
            empty = keyword(h) == "count" or (null_mode == "local" and keyword(h) in ("sum", "seed"))
            values[h] = F.coalesce(c, F.lit(0)).cast(has[h]) if empty else c
        return [_shaped(c, values.get(c), has.get(c), types[c]) for c in columns]

    aggregates = {h: (keyword(h), f"{c.kind} {c.text}", _value(c, kinds)) for h, c in spec.aggregates.items()}
    return SharedRow(list(dict.fromkeys(spec.groups.values())), "; ".join(spec.where), reduce(lambda a, b: a & b, tests) if tests else None, aggregates, output)


def _prepare(control, sheet, df: DataFrame) -> tuple[ControlTable, DataFrame]:
    table = as_control_table(control, sheet).lower().without(PROGRESS)
    df = tolower_colnames(df)
    return tolower_control_file_cells(table, ["group", "where", *AGGREGATES], df.columns), df


def validate_summary_control_file(control, df: DataFrame, sheet: str | None = None, save_file: str | None = None, check_data: bool = True) -> Report:
    """Checks against the schema only, but for one pass that counts values where ``check_data``."""
    report = Report()
    table, df = _prepare(control, sheet, df)
    names, types = df.columns, {f.name: f.dataType for f in df.schema.fields}
    kinds = {c: keyword(c) for c in table.columns}
    unknown = [c for c, k in kinds.items() if k not in KNOWN]
    report.check(not unknown, f"columns of no known kind: {some(unknown)}", warn=True)
    rows = table.enabled().rows
    if save_file is None and "file" in table.columns:
        on, every = {r["file"] for r in rows}, table.rows
        report.check(all(r["file"] is not None for r in rows), "FILE is missing in some rows")
        off = {r["file"] for r in every if r not in rows}
        report.check(not on & off, f"files with some rows enabled and some not: {some(on & off)}")
    specs = [read_spec(r) for r in rows]
    report.check(all(s.aggregates for s in specs), "every row needs at least one summary")
    missing, seen = set(), set()
    for spec in specs:
        for h, c in spec.aggregates.items():
            kind = keyword(h)
            if c.kind == "column":
                there = bool(entity_parts(c.text, names)) if kind == "entity" else c.text in names
                missing |= set() if there else {c.text}
                if kind in ("sum", "seed") and there and not isinstance(types.get(c.text), T.NumericType):
                    report.check(False, f"{kind} of {c.text}, which is no number")
            elif c.kind == "dynamic" and (kind, c.text) not in seen:
                seen.add((kind, c.text))
                _try(report, c.text, df)
        for w in spec.where:
            if ("where", w) not in seen:
                seen.add(("where", w))
                _try(report, w, df)
        for g in spec.groups.values():
            report.check(not is_delimited(g, "{}"), f"a group can't be an expression: {g}")
            if not is_delimited(g, "{}") and g not in names:
                missing.add(g)
        own = list(spec.groups.values())
        report.check(len(set(own)) == len(own), f"a group column twice in one row: {some(own)}")
        entities = [c.text for h, c in spec.aggregates.items() if keyword(h) == "entity" and c.kind == "column" and c.text not in names]
        if entities:
            both = {c.text for c in spec.aggregates.values() if c.kind == "column"} & set(own)
            report.check(not both, f"grouped and summarised beside an entity of two columns: {some(both)}")
    report.check(not missing, f"columns that the data does not have: {some(missing)}")
    if check_data and report.ok:
        used = sorted({p for s in specs for h, c in s.aggregates.items() if c.kind == "column" for p in entity_parts(c.text, names)})
        if used:
            counts = df.agg(*(F.count(quote(c)).alias(f"c{i}") for i, c in enumerate(used))).first()
            empty = [c for i, c in enumerate(used) if not counts[i]]
            report.check(not empty, f"columns without any value: {some(empty)}", warn=True)
    return report


def _try(report: Report, text: str, df: DataFrame) -> None:
    if not no_obvious_escaping_injection(text):
        report.check(False, f"expression with unpaired brackets or quotes, or with ; or braces: {text}")
        return
    try:
        df.select(rexpr.to_column(text, dict(df.dtypes)))  # analysed, not run
    except Exception as e:
        report.check(False, f"expression {text!r}: {str(e).splitlines()[0]}")


def remove_empty_entities(specs: Sequence[SummarySpec], df: DataFrame) -> list[SummarySpec]:
    """Entity cells whose columns hold no value give nothing, so they are blanked: one pass for all of them."""
    wanted = sorted({p for s in specs for h, c in s.aggregates.items() if keyword(h) == "entity" and c.kind == "column" for p in entity_parts(c.text, df.columns)})
    if not wanted:
        return list(specs)
    counts = df.agg(*(F.count(quote(c)) for c in wanted)).first()
    full = {c for c, n in zip(wanted, counts, strict=True) if n}
    out = []
    for s in specs:
        keep = {h: c for h, c in s.aggregates.items() if keyword(h) != "entity" or c.kind != "column" or full & set(entity_parts(c.text, df.columns))}
        out.append(SummarySpec(s.labels, s.groups, keep, s.where, s.file))
    return out


def summarise(specs: Sequence[SummarySpec], df: DataFrame, columns: Sequence[str], share: str = "apart", **options) -> DataFrame:
    """One plan for rows that are known to be right; with ``share``, one scan for those that can share it."""
    frames = []
    for spec in specs:
        got = compile_row(spec, df, **options) if spec.aggregates else df.sparkSession.range(1).select(*(F.lit(v).alias(h) for h, v in spec.labels.items()))
        frames.append(got)
    together = [i for i, s in enumerate(specs) if can_share(s, df.columns)] if share != "apart" else []
    if len(together) < 2:
        return stack(frames, columns)
    types = _types(frames, columns)
    rows = [_shared_row(specs[i], df, frames[i], columns, types, options.get("null_mode", "local")) for i in together]
    out = shared(df, rows, share, options.get("remove_na_from_groups", True))
    rest = [f for i, f in enumerate(frames) if i not in together]
    return out.unionByName(stack(rest, columns, types)) if rest else out


#: The label that tells rows of a result by the control row they are of.
NUMBER = "number of the row"


class _Watched:
    """A result whose one execution also says what each control row came to.

    Counts and clocks are metrics of the task that writes a row, so they need no
    job of their own, and Spark counts a task that ran twice once.
    """

    def __init__(self, specs: Sequence[SummarySpec], df: DataFrame, columns: Sequence[str], **options):
        numbered = [replace(s, labels={**s.labels, NUMBER: i}) for i, s in enumerate(specs)]
        frame = summarise(numbered, df, [*columns, NUMBER], **options)
        self.seen, self.specs, self.began = Observation(), specs, time.time()
        frame = frame.withColumn("made at", F.reflect(F.lit("java.lang.System"), F.lit("currentTimeMillis")).cast("long"))
        mine = [F.col(quote(NUMBER)) == i for i in range(len(specs))]
        metrics = [x for i, m in enumerate(mine) for x in (F.count_if(m).alias(f"n{i}"), F.max(F.when(m, F.col("`made at`"))).alias(f"t{i}"))]
        self.df = frame.observe(self.seen, *metrics).drop(NUMBER, "made at")

    def outcomes(self) -> list[dict]:
        """Of each row, once the result was written: rows, seconds and end_time."""
        found, end = self.seen.get, time.time()
        out = []
        for i in range(len(self.specs)):
            at = end if found[f"t{i}"] is None else found[f"t{i}"] / 1000
            out.append({"rows": found[f"n{i}"], "seconds": max(0.0, at - self.began), "end_time": f"{datetime.fromtimestamp(at):%Y-%m-%d %H:%M:%S}"})
        return out


def _write(specs: Sequence[SummarySpec], df: DataFrame, columns: Sequence[str], path: str, new: bool, options: dict) -> list[dict]:
    """A result file, written in one job of all its rows; if that fails, each runs alone, and the file has those that end well.

    The file takes its new form in one step, after all that runs has run.
    """
    spark = df.sparkSession

    def lines(some_: Sequence[SummarySpec]) -> tuple[str, list[dict]]:
        watched = _Watched(some_, df, columns, **options)
        return write_lines(watched.df), watched.outcomes()

    got = attempt(lambda: lines(specs))
    if got["result"] is not None:
        parts, said = [got["result"][0]], got["result"][1]
        done = [{p: got[p] for p in ("status", "start_time")} | o for o in said]
    else:
        done, parts = [], []
        for s in specs:
            got = attempt(lambda s=s: lines([s])) if len(specs) > 1 else got
            result = got.pop("result")
            if result is not None:
                parts.append(result[0])
                got |= result[1][0]
            done.append(got)
    if parts:
        put = attempt(lambda: join_lines(spark, path, columns, parts, new))
        if put["status"] != SUCCESS:
            done = [d | {"status": put["status"], "rows": None} if d["status"] == SUCCESS else d for d in done]
    elif new:
        files_.remove(spark, path)
    return done


def run_summary(
    control,
    df: DataFrame,
    sheet: str | None = None,
    remove_na_from_groups: bool = True,
    save_file: str | None = None,
    save_folder: str | None = None,
    debug_folder: str | None = None,
    partial_output: bool = False,
    entity_where: str = "before_union",
    null_mode: str = "local",
    drop_empty_entities: bool = False,
    write: bool = False,
    share: str = "apart",
    distinct: str = "sets",
    resume: bool = False,
) -> SummaryResult:
    """Validates, compiles every enabled row, and stacks what compiled.

    A row that fails has its status say so and the others go on; without
    ``partial_output`` an invalid control file raises. Rows that compile are said to
    be planned, as the result is a plan that nothing has run; with all rows off there
    is a warning and no result. With ``write`` each
    result file is written, one job for all of its rows, which also gives each row's
    outcome: rows written, seconds until its last one was made, status. If that job
    fails, its rows run one by one to find whose fault it was. Rows that give nothing
    are warned of. A control file given by
    path gets the progress written back after each result file, so a run that is lost
    can go on: with ``resume`` rows that the control file says were successful, and
    whose file is there, are left as they are, and only the others run and are added
    to it. A run lost between a file's taking its place and the progress being saved
    runs that file's rows again. ``share`` is how rows share a scan:
    "apart" (a scan for each), "rollup" or "sets" (see ``plans.shared``).
    ``distinct="bitmaps"`` counts distinct whole numbers by bitmaps, a scan for
    each, where "sets" copies each row for each distinct column of its control row.
    """
    if distinct not in ("sets", "bitmaps"):
        raise ValueError("distinct is one of sets, bitmaps")
    if share not in MODES:
        raise ValueError(f"share is one of {', '.join(MODES)}")
    if resume and not write:
        raise ValueError("resume is for results that are written")
    report = validate_summary_control_file(control, df, sheet, save_file, check_data=False)
    if not partial_output:
        report.require()
    full = as_control_table(control, sheet)
    table, df = _prepare(control, sheet, df)
    on = table.enabled()
    if not on.rows:
        warnings.warn("all rows of the control file are off", stacklevel=2)
        return SummaryResult(None, full, {})
    columns = output_columns(table.columns)
    specs = [read_spec(r) for r in on.rows]
    if drop_empty_entities:
        specs = remove_empty_entities(specs, df)
    options = {"remove_na_from_groups": remove_na_from_groups, "entity_where": entity_where, "null_mode": null_mode, "share": share, "distinct": distinct}
    done = [attempt(lambda s=s: summarise([s], df, columns, **options)) for s in specs]
    compiled = [d["result"] is not None for d in done]
    for d, ok in zip(done, compiled, strict=True):
        d |= {"status": PLANNED if ok else d["status"], "seconds": None}

    def status() -> ControlTable:
        progress = ControlTable([*on.columns, *PROGRESS], [{**r, **{p: d[p] for p in PROGRESS}} for r, d in zip(on.rows, done, strict=True)])
        out = _progress(full, table, progress)
        if isinstance(control, (str, os.PathLike)):
            save_control_file(str(control), out, sheet)
        return out

    before = _earlier(full, table) if resume else [None] * len(specs)
    targets: dict[str | None, list[int]] = {}
    for i, s in enumerate(specs):
        targets.setdefault(save_file or s.file, []).append(i)
    kept: set[int] = set()
    for name, rows in targets.items():
        if resume and name and files_.exists(df.sparkSession, _file(save_folder, name)):
            kept |= {i for i in rows if before[i] and compiled[i]}
    for i in kept:
        done[i] |= before[i]
    out: dict[str, DataFrame] = {}
    for name, rows in targets.items():
        good = [i for i in rows if compiled[i]]
        if not good:
            continue
        frame = summarise([specs[i] for i in good], df, columns, **options)
        out[name or ""] = frame
        if debug_folder:
            save_code_to_script(frame._jdf.queryExecution().toString(), f"summary {name or 'result'}", debug_folder)
        if write and name:
            left = [i for i in good if i not in kept]
            if left:
                made = _write([specs[i] for i in left], df, columns, _file(save_folder, name), not kept & set(good), options)
                for i, d in zip(left, made, strict=True):
                    done[i] |= d
                status()
    found = [Outcome(i, save_file or s.file, d["status"], d.get("rows"), d["seconds"]) for i, (s, d) in enumerate(zip(specs, done, strict=True))]
    if nothing := [o.row + 1 for o in found if o.rows == 0]:
        warnings.warn(f"enabled rows that gave nothing: {some(nothing)}", stacklevel=2)
    every = [s for s, d in zip(specs, done, strict=True) if d["status"] in (SUCCESS, PLANNED)]
    return SummaryResult(summarise(every, df, columns, **options) if every else None, status(), out, found)


def _file(folder: str | None, name: str) -> str:
    return os.path.join(folder, name) if folder else name


def _earlier(full: ControlTable, table: ControlTable) -> list[dict | None]:
    """Of enabled rows that an earlier run says were successful, their progress."""
    on = {id(r) for r in table.enabled().rows}
    out = []
    for old, row in zip(full.rows, table.rows, strict=True):
        if id(row) in on:
            said = {p: v for c, v in old.items() if (p := c.strip().lower()) in PROGRESS}
            out.append({p: said.get(p) for p in PROGRESS} if said.get("status") == SUCCESS else None)
    return out


def _progress(full: ControlTable, table: ControlTable, progress: ControlTable) -> ControlTable:
    """Progress rows in place: by row, as cells may have changed case."""
    on = {id(r) for r in table.enabled().rows}
    out = ControlTable([*full.without(PROGRESS).columns, *PROGRESS])
    it = iter(progress.rows)
    for old, row in zip(full.rows, table.rows, strict=True):
        lower = {c.lower(): v for c, v in old.items()}
        got = next(it) if id(row) in on else lower
        out.rows.append({**{c: old[c] for c in out.columns if c not in PROGRESS}, **{p: got.get(p) for p in PROGRESS}})
    return out


__all__ = ["Outcome", "SummaryResult", "SummarySpec", "merge_progress", "run_summary", "summarise", "validate_summary_control_file"]
