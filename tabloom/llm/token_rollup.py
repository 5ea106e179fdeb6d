"""Token counts as delta-maintained rollups.

Totals of documents and tokens by source, language and tokenizer version are
never counted anew: each batch of inserts (+), deletes (-) and revised counts
(- old, + new) is summed to signed deltas by group and committed under its batch
id. A batch that is there already changes nothing, so that a retried or repeated
commit counts once. Totals are the sum of all deltas; compaction folds the
deltas so far into one.

Layout of a rollup's folder: ``deltas/<batch id>`` holds a batch's Parquet files,
moved there in one rename after they are complete; ``staging`` holds what is
being written; ``folded/<n>`` holds a compacted sum with the list of the batches
in it. Of several writers of one name that one wins who makes its file in
``claims``, which can be made once and names the writer's complete files; whoever
finds a claim whose files have not moved moves them, so a writer may be lost at
any point but between making a claim and naming its files there: an empty claim
stays, with no batch, until it is deleted by hand. Compaction leaves what the compaction before it left out, so totals
planned before a compaction can still be read after it, and not after two.

Defined results: null sources, languages and versions are groups of their own; a
null count counts as 0 tokens of one document; repeated rows count as often as
they come; a batch without rows commits and changes nothing; groups whose totals
are all zero are left out; extra columns are ignored.
"""

from __future__ import annotations

import re
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GROUP = ["source", "lang", "tokenizer"]
_DELTA = "source string, lang string, tokenizer string, docs long, tokens long"
_FOLDED = f"{_DELTA}, batches array<string>"


class Rollup:
    """A rollup kept in a folder that all of the cluster can reach."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        at = self._path(f"{self.root}/{folder}")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def _commit(self, df: DataFrame, folder: str, name: str) -> bool:
        """Writes aside, claims the name, then renames; whether this writer has the name."""
        aside = uuid.uuid4().hex
        df.coalesce(1).write.parquet(f"{self.root}/staging/{aside}")  # one row for each group
        if not self._take(self._claim(folder, name), aside):
            self._fs.delete(self._path(f"{self.root}/staging/{aside}"), True)
            self._finish(folder, name)
            return False
        self._finish(folder, name)
        return True

    def _take(self, claim, text: str) -> bool:
        """Makes a file that only one can make; the local file system has no such call of Spark's, so there it is the system's own."""
        if self._fs.getScheme() == "file":
            self._fs.mkdirs(claim.getParent())
            try:
                with open(claim.toUri().getPath(), "x", encoding="ascii") as f:
                    f.write(text)
            except FileExistsError:
                return False
            return True
        try:
            out = self._fs.create(claim, False)
        except Py4JJavaError:
            if not self._fs.exists(claim):
                raise
            return False
        out.write(bytearray(text, "ascii"))
        out.close()
        return True

    def _claim(self, folder: str, name: str):
        return self._path(f"{self.root}/claims/{folder}-{name}")

    def _finish(self, folder: str, name: str) -> None:
        """Moves the files that a claim names, if they have not moved; a claim that is being written is its writer's to finish."""
        to, claim = self._path(f"{self.root}/{folder}/{name}"), self._claim(folder, name)
        stream = self._fs.open(claim)
        try:
            aside = bytes(stream.readAllBytes()).decode("ascii")
        finally:
            stream.close()
        at = self._path(f"{self.root}/staging/{aside}")
        if aside and self._fs.exists(at) and not self._fs.exists(to):
            self._fs.mkdirs(self._path(f"{self.root}/{folder}"))
            try:
                self._fs.rename(at, to)
            except Py4JJavaError:  # another has moved them meanwhile
                if not self._fs.exists(to):
                    raise

    def batches(self) -> set[str]:
        """Ids of all committed batches, folded ones too."""
        folded = self._folded()
        return set(self._names("deltas")) | (folded[1] if folded else set())

    def _folded(self) -> tuple[str, set[str]] | None:
        names = self._names("folded")
        if not names:
            return None
        last = max(names, key=int)
        held = self.spark.read.schema(_FOLDED).parquet(f"{self.root}/folded/{last}").select(F.explode("batches").alias("b")).distinct()
        return last, {r.b for r in held.collect()}

    def apply(self, batch: str, inserts: DataFrame | None = None, deletes: DataFrame | None = None, revisions: DataFrame | None = None) -> bool:
        """Commits a batch; False if it was committed before.

        ``inserts`` and ``deletes`` have source, lang, tokenizer and n_tokens;
        ``revisions`` has old_tokens and new_tokens in place of n_tokens. Sums are
        formed before rows move, so a group of any size is no hot spot.
        """
        if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9_-]*", batch):
            raise ValueError(f"batch id {batch!r}: letters, digits, - and _ only")
        if batch in self.batches():
            return False
        if self._fs.exists(self._claim("deltas", batch)):
            self._finish("deltas", batch)
            return False
        n = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0))
        signed = []
        for df, docs, tokens in ((inserts, 1, lambda: n("n_tokens")), (deletes, -1, lambda: -n("n_tokens")), (revisions, 0, lambda: n("new_tokens") - n("old_tokens"))):
            if df is not None:
                signed.append(df.select(*(F.col(c).cast("string").alias(c) for c in GROUP), F.lit(docs).cast("long").alias("docs"), tokens().alias("tokens")))
        delta = self.spark.createDataFrame([], _DELTA)
        for s in signed:
            delta = delta.unionByName(s)
        return self._commit(_sum(delta), "deltas", batch)

    def _deltas(self) -> tuple[DataFrame, set[str]]:
        folded = self._folded()
        df, inside = self.spark.createDataFrame([], _DELTA), set()
        if folded:
            df = df.unionByName(self.spark.read.schema(_FOLDED).parquet(f"{self.root}/folded/{folded[0]}").drop("batches"))
            inside = folded[1]
        open_ = [b for b in self._names("deltas") if b not in inside]
        if open_:
            df = df.unionByName(self.spark.read.schema(_DELTA).parquet(*(f"{self.root}/deltas/{b}" for b in open_)))
        return df, inside | set(open_)

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, docs, tokens of all committed batches."""
        return _sum(self._deltas()[0])

    def compact(self) -> None:
        """Folds all deltas so far into one sum; what the sum before it had folded goes."""
        df, batches = self._deltas()
        names, folded = self._names("folded"), self._folded()
        at = max(map(int, names), default=0) + 1
        listed = self.spark.createDataFrame([(None, None, None, 0, 0, sorted(batches))], _FOLDED)
        if not self._commit(_sum(df).withColumn("batches", F.array().cast("array<string>")).unionByName(listed), "folded", str(at)):
            return  # another compaction was first
        for b in (folded[1] if folded else set()) & set(self._names("deltas")):
            self._fs.delete(self._path(f"{self.root}/deltas/{b}"), True)
        for old in names:
            if old != (folded and folded[0]):
                self._fs.delete(self._path(f"{self.root}/folded/{old}"), True)


def _sum(delta: DataFrame) -> DataFrame:
    return delta.groupBy(*GROUP).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs != 0 or tokens != 0")


#: Ways to count: version to pattern.
VERSIONS = {"space-1": r"[^\x20\x09-\x0D]+", "alnum-1": r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"}


def n_tokens(version: str, text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(VERSIONS[version])), F.lit(0)).cast("long")
