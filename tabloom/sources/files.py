"""Files by Spark's file systems: paths that only they can open, local ones too."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    """The file system of a path (a local one without checksum files beside it), and the path."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.getScheme() == "file":
        fs = spark._jvm.org.apache.hadoop.fs.RawLocalFileSystem()
        fs.initialize(spark._jvm.java.net.URI("file:///"), spark._jsc.hadoopConfiguration())
    return fs, at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _at(spark, path)
    return fs.exists(at)


def remove(spark: SparkSession, path: str) -> bool:
    fs, at = _at(spark, path)
    return fs.delete(at, True)


def put_together(spark: SparkSession, target: str, folders: Sequence[str], head: str, new: bool = False) -> None:
    """Appends the part files of folders, in their order, to a file; one that is new, or made so, starts with ``head``.

    Bytes are copied between streams beside the target, which then takes its
    place, so readers see the old file or the new one.
    """
    fs, to = _at(spark, target)
    aside = spark._jvm.org.apache.hadoop.fs.Path(f"{target}.being-written")
    copy = spark._jvm.org.apache.hadoop.io.IOUtils.copyBytes
    if (parent := to.getParent()) is not None:
        fs.mkdirs(parent)
    out = fs.create(aside, True)
    try:
        if fs.exists(to) and not new:
            _copy(copy, fs.open(to), out)
        else:
            out.write(bytearray(head, "utf-8"))
        for folder in folders:
            parts, at = _at(spark, folder)
            for name in sorted(_names(parts, at)):
                _copy(copy, parts.open(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")), out)
    finally:
        out.close()
    if fs.exists(to):
        fs.delete(to, False)
    fs.rename(aside, to)


def _copy(copy, stream, out) -> None:
    try:
        copy(stream, out, 65536, False)
    finally:
        stream.close()


def _names(fs, at) -> Sequence[str]:
    return [n for s in fs.listStatus(at) if (n := s.getPath().getName()).startswith("part-")]
