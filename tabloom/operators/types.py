"""SQL Server type names and the Spark types they become."""

from __future__ import annotations

import re

#: Accepted names and what holds their values.
TYPES = {
    "TINYINT": "smallint", "SMALLINT": "smallint", "INT": "int", "BIGINT": "bigint", "BIT": "int",
    "DECIMAL": "decimal(18,0)", "NUMERIC": "decimal(18,0)", "MONEY": "decimal(19,4)", "SMALLMONEY": "decimal(10,4)",
    "FLOAT": "double", "REAL": "float", "DATE": "date", "TIME": "string",
    "DATETIME": "timestamp", "DATETIME2": "timestamp", "SMALLDATETIME": "timestamp", "DATETIMEOFFSET": "timestamp",
    "CHAR": "string", "VARCHAR": "string", "NCHAR": "string", "NVARCHAR": "string", "TEXT": "string", "NTEXT": "string",
}


def _named(text: str) -> str | None:
    return next((w for w in re.findall(r"\w+", text.upper()) if w in TYPES), None)


def is_valid_data_type(text: str | None) -> bool:
    return bool(text) and _named(text) is not None


def spark_type(text: str) -> str:
    name = _named(text)
    if name is None:
        raise ValueError(f"not a data type: {text!r}")
    given = re.search(r"\(\s*(\d+)\s*(?:,\s*(\d+)\s*)?\)", text)
    if name in ("DECIMAL", "NUMERIC") and given:
        return f"decimal({min(int(given[1]), 38)},{int(given[2] or 0)})"
    return TYPES[name]


def text_length(text: str) -> int | None:
    """n of CHAR(n) and its kin."""
    given = re.search(r"CHAR\s*\(\s*(\d+)\s*\)", text.upper())
    return int(given[1]) if given else None
