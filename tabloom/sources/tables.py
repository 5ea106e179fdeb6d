"""Tables by name: frames that the caller gives, else those of the session."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from tabloom.functions.rexpr import quote
from tabloom.sources.names import sql2id


class Catalog:
    """Resolves [db].[schema].[table]: the whole name, then without leading parts."""

    def __init__(self, spark: SparkSession, frames: Mapping[str, DataFrame] | None = None):
        self.spark = spark
        self.frames = {".".join(sql2id(k)).lower(): v for k, v in (frames or {}).items()}

    def find(self, name: str) -> DataFrame | None:
        parts = sql2id(name)
        for i in range(len(parts)):
            rest = parts[i:]
            if (df := self.frames.get(".".join(rest).lower())) is not None:
                return df
            if len(rest) <= 3:
                at = ".".join(map(quote, rest))
                try:
                    if self.spark.catalog.tableExists(at):
                        return self.spark.table(at)
                except Exception:  # names of catalogs that the session does not have
                    continue
        return None

    def get(self, name: str) -> DataFrame:
        df = self.find(name)
        if df is None:
            raise ValueError(f"no table {name}")
        return df


def load_csv(spark: SparkSession, path: str, name: str | None = None, missing: str = "NA") -> DataFrame:
    """A CSV file as a table of inferred types; with a name, also as a view."""
    df = spark.read.option("header", True).option("inferSchema", True).option("nullValue", missing).option("encoding", "UTF-8").csv(path)
    df = df.toDF(*[c.lstrip("﻿") for c in df.columns])
    if name:
        df.createOrReplaceTempView(name)
    return df


def replace_table(spark: SparkSession, name: str, df: DataFrame) -> DataFrame:
    """A table of the catalog gets the rows of a frame, which may be made of it; it keeps its number of rows.

    The new table is written beside the old one, and counted, before two renames
    swap them; the old one goes last. What fails before leaves the old table as it
    was, and a run that was lost between the renames is mended by the next.
    """
    *space, own = sql2id(name)
    at = lambda suffix: ".".join(map(quote, [*space, own + suffix]))
    whole, staged, old = at(""), at("__staged"), at("__old")
    mend_table(spark, name)
    spark.sql(f"DROP TABLE IF EXISTS {staged}")
    try:
        df.write.saveAsTable(staged)
        had, has = spark.table(whole).count(), spark.table(staged).count()
        if had != has:
            raise ValueError(f"{name} has {had} rows, and its new version {has}")
    except Exception:
        spark.sql(f"DROP TABLE IF EXISTS {staged}")
        raise
    spark.sql(f"ALTER TABLE {whole} RENAME TO {old}")
    try:
        spark.sql(f"ALTER TABLE {staged} RENAME TO {whole}")
    except Exception:
        spark.sql(f"ALTER TABLE {old} RENAME TO {whole}")
        raise
    spark.sql(f"DROP TABLE {old}")
    return spark.table(whole)


def mend_table(spark: SparkSession, name: str) -> None:
    """After a run that was lost while it swapped: the old table gets its name back, or goes if the new one is in place."""
    *space, own = sql2id(name)
    whole, old = (".".join(map(quote, [*space, own + s])) for s in ("", "__old"))
    if spark.catalog.tableExists(old):
        if spark.catalog.tableExists(whole):
            spark.sql(f"DROP TABLE {old}")
        else:
            spark.sql(f"ALTER TABLE {old} RENAME TO {whole}")
