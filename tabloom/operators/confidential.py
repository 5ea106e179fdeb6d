"""Confidential: rounding and suppression of a table before release."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.functions import rounding
from tabloom.functions.rexpr import quote
from tabloom.operators.report import Report, some
from tabloom.sources.controlfile import ControlTable, as_control_table
from tabloom.sources.names import make_name

#: Fixed values of control files: commands, those with one row at most, kinds of rounding, and what says yes to a drop.
COMMANDS = ("DROP", "RENAME", "MISSING_TO", "ROUND", "SEED", "SUPPRESS", "NOTES")
SINGLE = ("DROP", "RENAME", "MISSING_TO", "ROUND", "SEED")
ROUNDINGS = ("RR3", "GRR", "CONV10", "CONV100", "CONV1000")
_DROP = {"true", "1", "t", "yes", "drop"}


@dataclass(frozen=True)
class Suppression:
    column: str
    threshold: float


def suppression_format_extract(text: str) -> Suppression:
    """``column < n`` or ``n > column``; nothing else."""
    for pattern, col, num in ((r"\s*(.+?)\s*<\s*([-+]?[\d.]+)\s*", 1, 2), (r"\s*([-+]?[\d.]+)\s*>\s*(.+?)\s*", 2, 1)):
        m = re.fullmatch(pattern, text)
        if m and not set("<>=") & set(m[col]):
            return Suppression(make_name(m[col]), float(m[num]))
    raise ValueError(f"not a suppression rule: {text!r}")


@dataclass
class ConfidentialSpec:
    columns: list[str]
    drop: list[str]
    rename: dict[str, str]
    missing_to: dict[str, float]
    seeds: dict[str, str]
    steps: dict[str, list[tuple[str, str]]]  #: column to (command, cell), top to bottom


def _rows(table: ControlTable) -> list[tuple[str, dict]]:
    head = table.columns[0]
    return [(str(r[head]).strip().upper(), {c: r[c] for c in table.columns[1:] if r[c] is not None}) for r in table.rows if r[head] is not None]


def read_spec(table: ControlTable) -> ConfidentialSpec:
    spec = ConfidentialSpec(table.columns[1:], [], {}, {}, {}, {})
    for command, cells in _rows(table):
        if command == "DROP":
            spec.drop = [c for c, v in cells.items() if str(v).lower() in _DROP]
        elif command == "RENAME":
            spec.rename = {c: str(v) for c, v in cells.items()}
        elif command == "MISSING_TO":
            spec.missing_to = {c: float(v) for c, v in cells.items()}
        elif command == "SEED":
            spec.seeds = {c: str(v) for c, v in cells.items()}
        elif command in ("ROUND", "SUPPRESS"):
            for c, v in cells.items():
                spec.steps.setdefault(c, []).append((command, str(v)))
    return spec


def validate_confidential_control_file(control, df: DataFrame, sheet: str | None = None) -> Report:
    report = Report()
    table = as_control_table(control, sheet)
    if not report.check(len(table.columns) > 1, "a command column and data columns are needed"):
        return report
    rows, names = _rows(table), df.columns
    mangled = {make_name(n): n for n in names}
    unknown = {c for c, _ in rows} - set(COMMANDS)
    report.check(not unknown, f"unknown commands: {some(unknown)}")
    missing = [c for c in table.columns[1:] if c not in mangled and c not in names]
    report.check(not missing, f"columns that the data does not have: {some(missing)}")
    for command in SINGLE:
        report.check(sum(c == command for c, _ in rows) <= 1, f"{command} may have one row only")
    renamed = {make_name(str(v)) for c, cells in rows if c == "RENAME" for v in cells.values()}
    known = set(mangled) | renamed
    thresholds: dict[str, set[float]] = {}
    for command, cells in rows:
        for column, cell in cells.items():
            text = str(cell)
            if command == "ROUND":
                report.check(text.upper() in ROUNDINGS, f"unknown rounding: {text}")
            elif command == "MISSING_TO":
                report.check(re.fullmatch(r"[-+]?\d*\.?\d+([eE][-+]?\d+)?", text) is not None, f"MISSING_TO takes a number, not {text}")
            elif command == "SEED":
                report.check(make_name(text) in known, f"no seed column {text}")
            elif command == "SUPPRESS":
                try:
                    rule = suppression_format_extract(text)
                except ValueError as e:
                    report.check(False, str(e))
                    continue
                if report.check(rule.column in known, f"no column {rule.column} for {text}"):
                    thresholds.setdefault(rule.column, set()).add(rule.threshold)
    old_of = {make_name(str(v)): c for c_, cells in rows if c_ == "RENAME" for c, v in cells.items()}
    for command, cells in rows:
        if command == "ROUND":
            for column, cell in cells.items():
                own = [t for c, ts in thresholds.items() if column in (c, old_of.get(c)) for t in ts]
                bands = {"RR3": [(3, (float("-inf"), float("inf")))], "GRR": list(zip([b for _, b in rounding.BANDS], rounding.BAND_THRESHOLDS, strict=True))}
                for base, (low, high) in bands.get(str(cell).upper(), []):
                    try:
                        rounding.check_thresholds(base, [t for t in own if low <= t <= high])
                    except ValueError as e:
                        report.check(False, f"{column}: {e}")
    return report


def _round(kind: str, x: Column, seed: Column, thresholds: Sequence[float]) -> Column:
    kind = kind.upper()
    if kind == "RR3":
        return rounding.random_rounding(x, seed, 3, thresholds)
    if kind == "GRR":
        return rounding.graduated_random_rounding(x, seed, thresholds)
    return rounding.conventional_rounding(x, int(kind[len("CONV") :]))


def run_confidential(control, df: DataFrame, sheet: str | None = None, stable_above: float = 30, row_key: Sequence[str] | None = None, salt: int = 0) -> DataFrame:
    """The table with a ``conf_`` column beside each column that has rules.

    Without ``row_key``, a row's own randomness comes from all of its values.
    Rows are treated one by one, so the plan is a projection: it never shuffles,
    and it also runs on streams.
    """
    validate_confidential_control_file(control, df, sheet).require()
    table = as_control_table(control, sheet)
    spec = read_spec(table)
    real = {make_name(c): c for c in df.columns} | {c: c for c in df.columns}
    key = F.xxhash64(*(F.col(quote(real[c])).cast("string") for c in (row_key or df.columns)))
    value = {}
    for c in df.columns:
        value[c] = F.col(quote(c))
    for c, number in spec.missing_to.items():
        c = real[c]
        value[c] = F.coalesce(value[c], F.lit(int(number) if number == int(number) else number))
    new_name = {real[c]: v for c, v in spec.rename.items()}
    shown = {c: new_name.get(c, c) for c in df.columns}
    by_name = {make_name(v): c for c, v in shown.items()}

    def old(name: str) -> str:
        """A column by its new name or, failing that, its old one."""
        return by_name.get(make_name(name)) or real[name if name in real else make_name(name)]

    rules = {c: [suppression_format_extract(v) for _, v in steps if _ == "SUPPRESS"] for c, steps in spec.steps.items()}
    thresholds: dict[str, list[float]] = {}
    for own in rules.values():
        for r in own:
            thresholds.setdefault(old(r.column), []).append(r.threshold)
    added = []
    for c in spec.columns:
        if c not in spec.steps:
            continue
        source = real[c]
        out = value[source]
        seed = value[old(spec.seeds[c])] if c in spec.seeds else rounding.stable_seeds(value[source], key, stable_above, salt)
        for command, cell in spec.steps[c]:
            if command == "ROUND":
                out = _round(cell, out, seed, thresholds.get(source, []))
            else:
                rule = suppression_format_extract(cell)
                out = rounding.suppress_small(out, value[old(rule.column)], rule.threshold)
        added.append(out.alias(f"conf_{shown[source]}"))
    gone = {real[c] for c in spec.drop}
    return df.select(*(value[c].alias(shown[c]) for c in df.columns if c not in gone), *added)
