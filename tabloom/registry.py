"""Where the catalogue's queries and their SQL are kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def add(name: str, oracle: str, fn: Callable[[SparkSession, str], DataFrame]) -> None:
    QUERIES[name], ORACLES[name] = fn, oracle


#: Checks of file and text helpers, which read no table: name to (what to found, how to find it). Tests run them.
CHECKS: dict[str, tuple[dict[str, str], Callable[[SparkSession, str], dict[str, object]]]] = {}
