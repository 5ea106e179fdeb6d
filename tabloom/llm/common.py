"""What the operators of this subpackage share: tables, work folders, words."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes to spaces for words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z.
ALNUM = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20
    for c in range(256)
)

_own_dir: list[str] = []


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster; one of our own only where the session names none."""
    if shared := spark.conf.get("spark.checkpoint.dir", None):
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _own_dir:
        held = tempfile.TemporaryDirectory(prefix="tabloom-")
        atexit.register(held.cleanup)
        _own_dir.append(f"file://{held.name}")
    return _own_dir[0]


def bound_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Texts are long: fewer rows at a time between JVM and Python, so that a batch stays small in both."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= rows:
        spark.conf.set(key, rows)


class Store:
    """Tables written to the shared folder, so that a lost executor costs no lineage.

    ``keep`` writes and rereads a frame, and lets go of what making it took; ``drop`` removes tables that nothing
    needs any more. What is left goes when the Python process ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        bound_batches(spark)
        self.root = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
        atexit.register(self.drop)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.root}/{name}")
        release(self.spark)
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop(self, *names: str) -> None:
        try:
            jvm = self.spark._jvm
            for at in [f"{self.root}/{n}" for n in names] or [self.root]:
                path = jvm.org.apache.hadoop.fs.Path(at)
                path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # at exit the JVM may be gone already; the folder's owner cleans up then
            if names:
                raise


def release(spark: SparkSession) -> None:
    """Lets go of shuffle files, broadcasts and the driver's free memory of steps that are over.

    Spark's cleaner removes them when the driver's garbage is collected, and a
    driver that only plans puts that off for long, while executors' disks fill.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    give_back()
    trim_driver(spark)


def trim_driver(spark: SparkSession) -> bool:
    """Free native memory of the driver's JVM goes back to the system, where the JVM has a command for that; whether it has.

    Each exchange of a plan runs in a thread of its own, and the C library keeps what compilers and
    such threads freed in up to eight arenas for each core, which otherwise only grow.
    """
    gateway, jvm = spark.sparkContext._gateway, spark.sparkContext._jvm
    try:
        name = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        args = gateway.new_array(jvm.java.lang.Object, 4)
        args[0], args[1] = name, "systemTrimNativeHeap"
        # the server's own class is closed to reflection, its interface is not
        of = jvm.java.lang.Class.forName("javax.management.MBeanServer")
        invoke = next(m for m in of.getMethods() if m.getName() == "invoke")
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)
    except Py4JJavaError:
        return False
    return True


def tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that no column of the frame has, in any case."""
    have = {c.lower() for c in df.columns}
    mark = "_"
    while any(f"{mark}{n}".lower() in have for n in names):
        mark += "_"
    return [mark + n for n in names]


def with_fields(df: DataFrame, *fields: T.StructField) -> T.StructType:
    """The frame's schema with more fields; fields of the same names (in any case) give way."""
    taken = {f.name.lower() for f in fields}
    return T.StructType([f for f in df.schema.fields if f.name.lower() not in taken] + list(fields))


def texts(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """UTF-8 bytes of each text; null counts as empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def held_out(modulus: int, remainder: int):
    """crc32 of the id's decimal digits, by remainder; a null id is never held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % modulus == remainder, F.lit(False))


def cut_at(df: DataFrame, column: str, most: int) -> int:
    """A count from which at most ``most`` rows of positive counts are left, as close as bands of 1/32 octave allow.

    The driver gets a row for each band, whatever the size of ``df``.
    """
    band = F.floor(F.log2(column) * 32)
    bands = df.where(F.col(column) > 0).groupBy(band.alias("band")).agg(F.count("*").alias("n"), F.min(column).alias("least")).collect()
    left, cut = most, 1 << 62
    for r in sorted(bands, key=lambda r: -r.band):
        if r.n > left:
            break
        left, cut = left - r.n, r.least
    return cut


def drop_ids(df: DataFrame, ids: DataFrame, column: str, most: int = 2_000_000) -> DataFrame:
    """Rows whose id is not in ``ids``: by broadcast while there are at most ``most`` of them, else by a join on both sides."""
    ids = ids.select(column).distinct()
    few = ids.limit(most + 1).count() <= most
    return df.join(F.broadcast(ids) if few else ids, column, "left_anti")


def parts(batch: list[bytes], most: int = 4_000_000) -> Iterator[list[bytes]]:
    """Runs of texts of so many bytes (or one longer text)."""
    part, size = [], 0
    for text in batch:
        if part and size + len(text) > most:
            yield part
            part, size = [], 0
        part.append(text)
        size += len(text)
    if part:
        yield part


_caches: dict[str, Callable[[], None]] = {}
_owner: list[str] = []


def give_back() -> None:
    """Free memory of this Python process goes back to the system, where the C library can do that."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def take_worker(owner: str, clear: Callable[[], None] | None = None) -> None:
    """To be called in a task: a reused Python worker remembers things for one operator at a time.

    What another operator left is cleared, and freed memory goes back to the
    system where the C library can do that.
    """
    if _owner != [owner]:
        _owner[:] = [owner]
        for other in [o for o in _caches if o != owner]:
            _caches.pop(other)()
        gc.collect()
        give_back()
    if clear is not None:
        _caches[owner] = clear
