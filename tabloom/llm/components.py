"""Connected components by alternating large and small stars, in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import Store


def _mins(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("u").agg(F.min("v").alias("low")).select(F.col("u").alias("at"), F.least("u", "low").alias("m"))


def _large(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours move to the least node around it."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    moved = both.where("v > u").join(_mins(both), F.col("u") == F.col("at")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.where("u != v").distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours move to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    mins = _mins(down)
    moved = down.join(mins, F.col("u") == F.col("at")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = mins.select(F.col("at").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(own).where("u != v").distinct()


def components(edges: DataFrame, store: Store, name: str) -> DataFrame:
    """node, root (least node of the component) for long edges (u, v); nodes without an edge to another are left out.

    No links come to the driver, only a count and a checksum for each round.
    """
    now = store.keep(edges.select("u", "v").where("u != v").distinct(), f"{name}-0")
    seen, step = None, 0
    while True:
        step += 1
        now = store.keep(_small(_large(now)), f"{name}-{step}")
        if step > 1:
            store.drop(f"{name}-{step - 2}")
        found = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(found) == seen:
            break
        seen = tuple(found)
    roots = now.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
