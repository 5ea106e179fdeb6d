"""Spreadsheets as a data source: ``spark.read.format("xlsx")``, after ``register``.

A partition is a sheet of a workbook, read as a stream. Option ``sheet``: its name
(else the first one), or ``*`` for all sheets, which then need the first one's
header. The path is a workbook, or a folder or pattern of workbooks, that the
tasks' own machines can open; ``file:`` may stand before it. Without a schema all
columns are text, as in control files; with one, cells become whole numbers,
doubles, truth values or text, and cells that are none are missing.
"""

from __future__ import annotations

import glob
import os
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tabloom.sources import xlsx
from tabloom.sources.names import make_names

_MISSING = ("", "NA")


def workbooks(path: str) -> list[str]:
    path = path.removeprefix("file://") if path.startswith("file://") else path.removeprefix("file:")
    found = [path] if os.path.isfile(path) else sorted(glob.glob(os.path.join(path, "*.xlsx") if os.path.isdir(path) else path))
    if not found:
        raise ValueError(f"no workbook at {path}")
    return found


def header(path: str, sheet: str | None) -> list[str]:
    """Names of columns, by the first row that is not empty."""
    first = next((r for r in xlsx.stream_sheet(path, sheet) if any(r)), [])
    return make_names([c.strip() for c in first])


def _value(text: str, kind: T.DataType):
    text = text.strip()
    if text in _MISSING:
        return None
    try:
        if isinstance(kind, T.IntegralType):
            return int(text) if text.lstrip("+-").isdigit() else int(float(text)) if float(text).is_integer() else None
        if isinstance(kind, T.FractionalType):
            return float(text)
    except (ValueError, OverflowError):
        return None
    if isinstance(kind, T.BooleanType):
        return {"TRUE": True, "FALSE": False, "1": True, "0": False}.get(text.upper())
    return text


@dataclass
class Sheet(InputPartition):
    path: str
    sheet: str | None


class XlsxSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "xlsx"

    def _sheet(self) -> str | None:
        return self.options.get("sheet")

    def schema(self) -> T.StructType:
        first = workbooks(self.options["path"])[0]
        sheet = self._sheet()
        return T.StructType([T.StructField(n, T.StringType()) for n in header(first, None if sheet == "*" else sheet)])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return XlsxReader(schema, self.options["path"], self._sheet())


class XlsxReader(DataSourceReader):
    def __init__(self, schema: T.StructType, path: str, sheet: str | None):
        allowed = (T.IntegralType, T.DoubleType, T.FloatType, T.BooleanType, T.StringType)
        if bad := [f.name for f in schema.fields if not isinstance(f.dataType, allowed)]:
            raise ValueError(f"cells become whole numbers, doubles, truth values or text: {', '.join(bad)}")
        self.fields, self.path, self.sheet = schema.fields, path, sheet

    def partitions(self) -> list[InputPartition]:
        return [Sheet(p, s) for p in workbooks(self.path) for s in (xlsx.sheet_names(p) if self.sheet == "*" else [self.sheet])]

    def read(self, partition: Sheet) -> Iterator[tuple]:
        rows = (r for r in xlsx.stream_sheet(partition.path, partition.sheet) if any(r))
        names = make_names([c.strip() for c in next(rows, [])])
        at = {n.lower(): i for i, n in enumerate(names)}
        if lost := [f.name for f in self.fields if f.name.lower() not in at]:
            raise ValueError(f"sheet {partition.sheet or 'one'} of {partition.path} has no column {', '.join(lost)}")
        places = [(at[f.name.lower()], f.dataType) for f in self.fields]
        for row in rows:
            cells = tuple(_value(row[i], kind) if i < len(row) else None for i, kind in places)
            if any(c is not None for c in cells):
                yield cells


def register(spark: SparkSession) -> None:
    spark.dataSource.register(XlsxSource)


def load_xlsx(spark: SparkSession, path: str, sheet: str | None = None, schema: str | None = None) -> DataFrame:
    register(spark)
    reader = spark.read.format("xlsx")
    reader = reader.option("sheet", sheet) if sheet else reader
    return (reader.schema(schema) if schema else reader).load(path)
