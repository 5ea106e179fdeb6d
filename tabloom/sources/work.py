"""Tables that are written so that what follows need not make them again."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    """A folder that is not there yet, where all executors can write; what is not dropped goes when Python ends."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if not _own:
            held = tempfile.TemporaryDirectory(prefix="tabloom-")
            atexit.register(held.cleanup)
            _own.append(f"file://{held.name}")
        shared = _own[0]
    path = f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    atexit.register(drop, spark, path)
    return path


def stored(df: DataFrame, name: str, with_path: bool = False):
    """The frame, run now and read back from the folder that all executors share."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    return (out, path) if with_path else out


def drop(spark: SparkSession, path: str) -> None:
    """A stored table goes, if it is still there and the session too."""
    try:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # at exit the JVM may be gone already; the folder's owner cleans up then
        return
