"""Control files: CSV or XLSX tables of text, kept on the driver."""

from __future__ import annotations

import csv
import re
from dataclasses import dataclass, field
from pathlib import Path

from tabloom.sources import xlsx
from tabloom.sources.names import make_names
from tabloom.sources.paths import increment_file_name, log, warn_if_excel_lockfile

#: Fixed values of control files: headers of progress, and what turns a row on.
PROGRESS = ["start_time", "end_time", "status"]
TRUTHY = {"true", "1", "t", "yes", "y"}


@dataclass
class ControlTable:
    """Column names and rows; a missing cell is None."""

    columns: list[str]
    rows: list[dict[str, str | float | None]] = field(default_factory=list)

    def copy(self) -> ControlTable:
        return ControlTable(list(self.columns), [dict(r) for r in self.rows])

    def lower(self) -> ControlTable:
        """Headers trimmed and in lower case."""
        names = [c.strip().lower() for c in self.columns]
        if len(set(names)) < len(names):
            raise ValueError("headers are not unique without case")
        return ControlTable(names, [{n: r[c] for n, c in zip(names, self.columns, strict=True)} for r in self.rows])

    def without(self, columns) -> ControlTable:
        keep = [c for c in self.columns if c.lower() not in columns]
        return ControlTable(keep, [{c: r[c] for c in keep} for r in self.rows])

    def enabled(self) -> ControlTable:
        """Rows that are on; without the column, all."""
        name = next((c for c in self.columns if c.lower() == "enabled"), None)
        if name is None:
            return self
        return ControlTable(self.columns, [r for r in self.rows if is_true(r[name])])


def is_true(cell) -> bool:
    return str(cell).strip().lower() in TRUTHY if cell is not None else False


def make_table(cells: list[list[str]]) -> ControlTable:
    """Header mangled to unique names; cells trimmed, empty and NA ones missing; empty rows dropped."""
    if not cells:
        return ControlTable([])
    columns = make_names([c.strip() for c in cells[0]])
    rows = []
    for line in cells[1:]:
        line = [*line, *[""] * (len(columns) - len(line))]
        row = {c: (None if v.strip() in ("", "NA") else v.strip()) for c, v in zip(columns, line, strict=False)}
        if any(v is not None for v in row.values()):
            rows.append(row)
    for c in columns:
        if c.lower() == "order":
            for row in rows:
                row[c] = _number(row[c])
    return ControlTable(columns, rows)


def _number(text):
    try:
        return None if text is None else float(text)
    except ValueError:
        return None


def _read(path: str, sheet: str | None) -> list[list[str]]:
    kind = Path(path).suffix.lower()
    if kind not in (".csv", ".xlsx"):
        raise ValueError(f"a control file is .csv or .xlsx, not {path}")
    if kind == ".xlsx":
        return xlsx.read_sheet(path, sheet)
    with open(path, newline="", encoding="utf-8-sig") as f:
        return list(csv.reader(f))


def load_control_file(path: str, sheet: str | None = None) -> ControlTable:
    warn_if_excel_lockfile(path, delay=0)
    return make_table(_read(path, sheet))


def as_control_table(control, sheet: str | None = None) -> ControlTable:
    """A path, a ControlTable, or rows as dicts."""
    if isinstance(control, ControlTable):
        return control.copy()
    if isinstance(control, (str, Path)):
        return load_control_file(str(control), sheet)
    columns = list(dict.fromkeys(c for row in control for c in row))
    return make_table([columns, *[["" if row.get(c) is None else str(row[c]) for c in columns] for row in control]])


def merge_progress(control: ControlTable, progress: ControlTable) -> ControlTable:
    """Progress columns join on all shared ones.

    Enabled rows take the progress found for them, even if it is missing; others
    keep what they had. Order and header case stay; new columns come last.
    """
    lower = {c.lower(): c for c in control.columns}
    shared = [c for c in progress.columns if c.lower() in lower and c.lower() not in PROGRESS]
    new = [c for c in progress.columns if c.lower() in PROGRESS]
    found = {}
    for row in progress.rows:
        found.setdefault(tuple(_same(row[c]) for c in shared), row)
    out = ControlTable([*control.columns, *[c for c in new if c.lower() not in lower]])
    switch = lower.get("enabled")
    for row in control.rows:
        row = {c: row.get(c) for c in out.columns}
        if switch is None or is_true(row[switch]):
            hit = found.get(tuple(_same(row[lower[c.lower()]]) for c in shared))
            for c in new:
                row[lower.get(c.lower(), c)] = hit[c] if hit else None
        out.rows.append(row)
    return out


def _same(value):
    return str(float(value)) if isinstance(value, (int, float)) else value


def _cell(value) -> str:
    if value is None:
        return ""
    return str(int(value)) if isinstance(value, float) and value == int(value) else str(value)


def save_control_file(path: str, table: ControlTable, sheet: str | None = None, overwrite: bool = True) -> str:
    """Writes the table; beside the file, under the next free name, if it may not or cannot be replaced."""
    cells = [table.columns, *[[_cell(r[c]) for c in table.columns] for r in table.rows]]
    to = path if overwrite or not Path(path).exists() else increment_file_name(path)
    try:
        _write(to, cells, sheet)
    except OSError as e:
        log.warning("%s could not be written (%s)", to, e)
        to = increment_file_name(path)
        _write(to, cells, sheet)
    return to


def _write(path: str, cells: list[list[str]], sheet: str | None) -> None:
    if Path(path).suffix.lower() == ".xlsx":
        xlsx.write_sheet(path, cells, sheet)
        return
    with open(path, "w", newline="", encoding="utf-8") as f:
        csv.writer(f, lineterminator="\n").writerows(cells)


def save_control_file_w_progress(path: str, progress: ControlTable, sheet: str | None = None, overwrite: bool = True) -> str:
    return save_control_file(path, merge_progress(load_control_file(path, sheet), progress), sheet, overwrite)


def keyword(header: str) -> str:
    return re.sub(r"[0-9.]", "", header).strip().lower()
