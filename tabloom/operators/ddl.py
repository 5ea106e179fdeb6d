"""Adding and dropping columns: statement text for databases, and the same for frames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.operators.types import is_valid_data_type, spark_type


def _quoted(name: str) -> str:
    return "[" + name.strip().strip("[]") + "]"


def drop_column_sql(table: str, columns: Sequence[str], sqlite: bool = False, if_exists: bool = True) -> str:
    if sqlite:
        return "\n".join(f"ALTER TABLE {table} DROP COLUMN {_quoted(c)};" for c in columns)
    exists = "IF EXISTS " if if_exists else ""
    return f"ALTER TABLE {table} DROP COLUMN {exists}{', '.join(map(_quoted, columns))};"


def add_column_sql(table: str, columns: Sequence[str], types: Sequence[str], sqlite: bool = False) -> str:
    if len(columns) != len(types) or not all(map(is_valid_data_type, types)):
        raise ValueError("every column needs a valid data type")
    each = [f"{_quoted(c)} {t}" for c, t in zip(columns, types, strict=True)]
    if sqlite:
        return "\n".join(f"ALTER TABLE {table} ADD COLUMN {e};" for e in each)
    return f"ALTER TABLE {table} ADD {', '.join(each)};"


def drop_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.drop(*columns)


def add_columns(df: DataFrame, columns: Sequence[str], types: Sequence[str]) -> DataFrame:
    return df.select("*", *(F.lit(None).cast(spark_type(t)).alias(c) for c, t in zip(columns, types, strict=True)))
