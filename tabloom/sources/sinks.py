"""Results as one CSV file: tasks write its lines, and their files are put together in order."""

from __future__ import annotations

import decimal
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.functions.rexpr import quote
from tabloom.sources import files
from tabloom.sources.work import drop, new_path


def format_value(v) -> str:
    """Texts quoted, missing as NA, numbers without exponent."""
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NA"
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    if isinstance(v, int):
        return str(v)
    if isinstance(v, (float, decimal.Decimal)):
        if isinstance(v, float) and math.isinf(v):
            return "Inf" if v > 0 else "-Inf"
        text = format(decimal.Decimal(repr(v)) if isinstance(v, float) else v, "f")
        return text.rstrip("0").rstrip(".") if "." in text else text
    return '"' + str(v).replace('"', '""') + '"'


def _plain_decimal(text: Column) -> Column:
    """A decimal number as text without idle zeros."""
    return F.when(text.contains("."), F.regexp_replace(text, r"\.?0+$", "")).otherwise(text)


def _plain_double(x: Column) -> Column:
    """A double without exponent, by the digits that tell it from others."""
    text = F.abs(x).cast("string")
    mantissa, power = F.substring_index(text, "E", 1), F.substring_index(text, "E", -1).cast("int")
    digits = F.replace(mantissa, F.lit("."), F.lit(""))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
    n = F.length(digits)
    large = F.when(n <= power + 1, F.rpad(digits, power + 1, "0")).otherwise(F.concat(F.left(digits, power + 1), F.lit("."), F.substring(digits, power + 2, F.lit(400))))
    plain = F.when(text.contains("E"), F.when(power < 0, small).otherwise(large)).otherwise(text)
    sign = F.when(x < 0, "-").otherwise("")
    return F.when(F.isnan(x), "NA").when(F.abs(x) == float("inf"), F.concat(sign, F.lit("Inf"))).otherwise(F.concat(sign, _plain_decimal(plain)))


def csv_value(x: Column, kind: str) -> Column:
    """A value of a type as ``format_value`` writes it."""
    if kind == "boolean":
        text = F.when(x, "TRUE").otherwise("FALSE")
    elif kind in ("tinyint", "smallint", "int", "bigint"):
        text = x.cast("string")
    elif kind in ("double", "float"):
        text = _plain_double(x.cast("double"))
    elif kind.startswith("decimal"):
        text = _plain_decimal(x.cast("string"))
    else:
        text = F.concat(F.lit('"'), F.replace(x.cast("string"), F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(x.isNull(), "NA").otherwise(text)


def write_lines(df: DataFrame) -> str:
    """The frame's lines of a CSV file, written by tasks to a folder of their own."""
    cells = [csv_value(F.col(quote(c)), k) for c, k in df.dtypes]
    parts = new_path(df.sparkSession, "csv")
    df.select(F.concat_ws(",", *cells).alias("value")).write.text(parts)
    return parts


def join_lines(spark: SparkSession, path: str, columns: Sequence[str], parts: Sequence[str], new: bool = False) -> None:
    """Folders of lines at the end of a file, in one step; with ``new``, an old file gives way. The folders go."""
    try:
        files.put_together(spark, path, parts, ",".join(map(format_value, columns)) + "\n", new)
    finally:
        for p in parts:
            drop(spark, p)


def append_csv(df: DataFrame, path: str) -> None:
    """The frame's rows at the end of a file, which starts with a header; no row comes to the driver.

    The path is one of Spark's: without a scheme it is on Spark's own file system.
    """
    join_lines(df.sparkSession, path, df.columns, [write_lines(df)])
