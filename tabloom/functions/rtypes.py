"""Kinds of values in row expressions, and how R turns one into another.

Kinds: null, bool, int, decimal, double, text, date, time, other; any, where the table's
types are not known, and then values are left as they are.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabloom.functions.parse import ExpressionError

NUMBERS = ("bool", "int", "decimal", "double")


@dataclass(frozen=True)
class Typed:
    column: Column
    kind: str


def kind_of(type_name: str) -> str:
    """Of a type of Spark's."""
    name = type_name.lower()
    if name in ("tinyint", "smallint", "int", "bigint"):
        return "int"
    if name in ("float", "double"):
        return "double"
    if name.startswith("decimal"):
        return "decimal"
    return {"boolean": "bool", "string": "text", "date": "date", "void": "null"}.get(name, "time" if name.startswith("timestamp") else "text" if name.startswith(("varchar", "char")) else "other")


def number_text(x: Column) -> Column:
    """A double as text: up to 15 digits, without exponent unless that is shorter."""
    size = F.abs(x.cast("double"))
    mantissa = F.format_string("%.14e", size)  # d.dddddddddddddde+xx
    digits = F.regexp_replace(F.replace(F.substring(mantissa, 1, 16), F.lit("."), F.lit("")), "0+$", "")
    power = F.substring_index(mantissa, "e", -1).cast("int")
    n = F.greatest(F.length(digits), F.lit(1))
    after = F.greatest(n - power - 1, F.lit(0))
    width = F.greatest(power + 1, F.lit(1)) + F.when(after > 0, after + 1).otherwise(0)
    short = F.when(n > 1, n + 1).otherwise(1) + F.when(F.abs(power) >= 100, 5).otherwise(4)
    whole = F.when(n <= power + 1, F.rpad(digits, power + 1, "0")).otherwise(F.concat(F.left(digits, power + 1), F.lit("."), F.substring(digits, power + 2, F.lit(20))))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
    exponent = F.concat(F.when(power < 0, "-").otherwise("+"), F.lpad(F.abs(power).cast("string"), F.greatest(F.length(F.abs(power).cast("string")), F.lit(2)), F.lit("0")))
    many = F.concat(F.left(digits, F.lit(1)), F.when(n > 1, F.concat(F.lit("."), F.substring(digits, 2, 20))).otherwise(""), F.lit("e"), exponent)
    plain = F.when(width > short, many).when(power >= 0, whole).otherwise(small)
    sign = F.when(x < 0, "-").otherwise("")
    return F.when(F.isnan(size), "NaN").when(size == float("inf"), F.concat(sign, F.lit("Inf"))).when(size == 0, "0").when(x.isNotNull(), F.concat(sign, plain))


def text_of(t: Typed) -> Column:
    """As as.character() writes a value."""
    if t.kind == "bool":
        return F.when(t.column, "TRUE").when(~t.column, "FALSE")
    return number_text(t.column) if t.kind in ("decimal", "double") else t.column.cast("string")


def pasted(t: Typed) -> Column:
    """As paste() writes a value."""
    return F.coalesce(text_of(t), F.lit("NA"))


def number_of(t: Typed, what: str = "an operator") -> Typed:
    """A truth value counts as 0 or 1; a text is no number."""
    if t.kind == "bool":
        return Typed(t.column.cast("int"), "int")
    if t.kind == "null":
        return Typed(F.lit(None).cast("double"), "double")
    if t.kind in ("text", "date", "time", "other"):
        raise ExpressionError(f"{what} takes numbers, not {'text' if t.kind == 'text' else t.kind + ' values'}")
    return t


def truth_of(t: Typed) -> Column:
    """As as.logical() takes a value."""
    if t.kind in ("int", "decimal", "double"):
        return t.column != 0
    if t.kind == "text":
        return F.when(t.column.isin("T", "TRUE", "true", "True"), True).when(t.column.isin("F", "FALSE", "false", "False"), False)
    if t.kind in ("date", "time", "other"):
        raise ExpressionError("a condition is a truth value or a number")
    return t.column.cast("boolean")


def alike(values: Sequence[Typed], compared: bool = False) -> tuple[list[Column], str]:
    """The values as one kind, and that kind: text before numbers, numbers before truth values.

    Where they are ``compared``, a text beside dates is read as one.
    """
    kinds = {t.kind for t in values} - {"null"}
    if len(kinds) <= 1 or "any" in kinds:
        return [t.column for t in values], next(iter(kinds), "null")
    if compared and kinds <= {"text", "date", "time"} and kinds != {"text"}:
        kind = "timestamp" if "time" in kinds else "date"
        return [t.column.try_cast(kind) for t in values], "time" if kind == "timestamp" else "date"
    if "text" in kinds:
        return [text_of(t) for t in values], "text"
    if kinds <= set(NUMBERS):
        return [number_of(t).column for t in values], next(k for k in ("double", "decimal", "int") if k in kinds)
    if kinds <= {"date", "time"}:
        return [t.column.cast("timestamp") for t in values], "time"
    raise ExpressionError(f"values of unlike kinds: {', '.join(sorted(kinds))}")
