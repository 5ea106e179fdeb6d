"""Importance resampling: draws documents as a target collection would have them.

Runs of one to N consecutive words are hashed to buckets. How much more often the
target uses a bucket than all documents do is its gain; a document's weight is
the mean gain of its features, and the documents with the best weights plus
Gumbel noise are a sample, without replacement, from the target's distribution.

Texts of more than ``CHUNK`` bytes are cut at word boundaries into chunks that are
dealt to all tasks, so a few very long texts burden none. A chunk owns the words
that start in it, and carries the next N - 1 words: a run belongs to the chunk
that owns its first word, so every run is counted once. Chunks are stored as
bucket numbers, two bytes for each feature; counting them and weighing them read
those numbers and no text. Counts and gains of a document's chunks are whole
numbers, so their sums are the same in any order.

Ranks come from one sort by range: partitions are numbered in order, rows within
them too, and each partition's offset is the sum of the sizes before it.

Defined results: a null text has no words; a text without features has weight 0; a
null doc_id hashes as an empty one and comes last among ties; rows of one id are
documents of their own (equal rows are interchangeable, each has a rank of its
own); without target texts all gains come from the documents alone; an empty
table gives no rows. Other columns are not read. The driver holds the gains, one
for each bucket, and the sizes of partitions.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import ALNUM, Store, parts, take_worker, tasks, texts

#: Longest run of words that is a feature, and buckets of features (at most 65,536).
RUN, BUCKETS = 2, 10_000
#: Bytes of a text that a chunk owns, about.
CHUNK = 16_384
#: Words that a document needs to be drawn, and how many of a hundred such documents are.
LEAST_WORDS, PERCENT = 20, 25
SEED = 7

_WORD = re.compile(rb"[^ ]+")
_CHUNKS = "row long, doc_id {id}, words long, buckets binary"


def pieces(text: bytes, run: int = RUN, size: int = CHUNK) -> Iterator[tuple[bytes, int]]:
    """Chunks of a text, and how many bytes of each it owns; the rest are words carried from the next."""
    text = text.translate(ALNUM)
    at = 0
    while at < len(text):
        end = text.find(b" ", at + size)
        stop = end = len(text) if end < 0 else end
        for _ in range(run - 1):
            if (word := _WORD.search(text, stop)) is None:
                break
            stop = word.end()
        yield text[at:stop], end - at
        at = end


def features(piece: bytes, owned: int, run: int = RUN, buckets: int = BUCKETS) -> tuple[int, np.ndarray]:
    """Words that a chunk owns, and the buckets of the runs that start with them."""
    words = piece.split()
    n = len(words) if owned >= len(piece) else len(piece[:owned].split())
    spaced = [b" " + w for w in words]
    hashes = list(map(crc32, words))
    found = hashes[:n]
    for m in range(1, run):
        # a run's hash goes on from that of the run that is a word shorter
        hashes = list(map(crc32, spaced[m:], hashes))
        found += hashes[:n]
    return n, (np.array(found, np.uint32) % np.uint32(buckets)).astype("<u2")


def _rows(rows: list, words: list, buckets: list, batch: pa.RecordBatch, at: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(rows, pa.int64()), batch.column("doc_id").take(pa.array(at, pa.int64())), pa.array(words, pa.int64()), pa.array(buckets, pa.binary())],
        names=["row", "doc_id", "words", "buckets"],
    )


def chunks(docs: DataFrame, run: int = RUN, buckets: int = BUCKETS, size: int = CHUNK) -> DataFrame:
    """row, doc_id, words, buckets: one row for a text of one chunk (row is null), else one for each chunk."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    long_ = F.coalesce(F.octet_length("text") > size, F.lit(False))

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_worker("resampling")
        for batch in batches:
            found, at = [], 0
            for part in parts(texts(batch, "text")):
                found = [features(t.translate(ALNUM), len(t), run, buckets) for t in part]
                yield _rows([None] * len(part), [n for n, _ in found], [b.tobytes() for _, b in found], batch, list(range(at, at + len(part))))
                at += len(part)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_worker("resampling")
        for batch in batches:
            rows = batch.column("row").to_pylist()
            for at, text in enumerate(texts(batch, "text")):
                each = list(pieces(text, run, size))
                columns = [pa.array([rows[at]] * len(each), pa.int64()), batch.column("doc_id").take(pa.array([at] * len(each), pa.int64()))]
                columns += [pa.array(range(len(each)), pa.int64()), pa.array([n for _, n in each], pa.int64()), pa.array([p for p, _ in each], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["row", "doc_id", "chunk", "owned", "piece"])

    def long(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_worker("resampling")
        for batch in batches:
            found = [features(p, n, run, buckets) for p, n in zip(batch.column("piece").to_pylist(), batch.column("owned").to_pylist(), strict=True)]
            yield _rows(batch.column("row").to_pylist(), [n for n, _ in found], [b.tobytes() for _, b in found], batch, list(range(len(found))))

    schema = _CHUNKS.format(id=kind)
    narrow = docs.select("doc_id", "text")
    # a long text's number is given before its chunks part
    numbered = narrow.withColumn("row", F.monotonically_increasing_id()).where(long_)
    dealt = numbered.mapInArrow(cut, f"row long, doc_id {kind}, chunk long, owned long, piece binary").repartition(tasks(docs.sparkSession), "row", "chunk")
    return narrow.where(~long_).mapInArrow(short, schema).unionByName(dealt.mapInArrow(long, schema))


def counts(chunked: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features in each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            total += np.bincount(np.frombuffer(b"".join(batch.column("buckets").to_pylist()), "<u2"), minlength=buckets)
        (at,) = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in chunked.select("buckets").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """For each bucket a thousand times the logarithm of its share in the target over that in the source, both smoothed by one; floored."""
    s_all, t_all, n = int(source.sum()), int(target.sum()), len(source)
    ratio = ((t + 1.0) * (s_all + n) / ((s + 1.0) * (t_all + n)) for s, t in zip(source.tolist(), target.tolist(), strict=True))
    return np.array([math.floor(1000 * math.log(r)) for r in ratio], np.int64)


def weigh(chunked: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, words, n_features, weight of each document."""
    kind = chunked.schema["doc_id"].dataType.simpleString()
    held = chunked.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column("buckets").to_pylist()
            ends = np.cumsum([0] + [len(b) // 2 for b in raw])
            upto = np.concatenate(([0], np.cumsum(held.value[np.frombuffer(b"".join(raw), "<u2")])))
            columns = [batch.column("row"), batch.column("doc_id"), batch.column("words"), pa.array(np.diff(ends)), pa.array(upto[ends[1:]] - upto[ends[:-1]])]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "doc_id", "words", "n_features", "gain"])

    each = chunked.mapInArrow(run, f"row long, doc_id {kind}, words long, n_features long, gain long")
    whole = each.where("row is not null").groupBy("row", "doc_id").agg(*(F.sum(c).alias(c) for c in ("words", "n_features", "gain")))
    n = "nullif(n_features, 0)"
    weight = F.coalesce(F.expr(f"(gain - pmod(gain, {n})) div {n}"), F.lit(0).cast("long"))
    return each.where("row is null").unionByName(whole).select("doc_id", "words", "n_features", weight.alias("weight"))


def noise(seed: int = SEED):
    """A thousand times a Gumbel variate of the id, floored."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, run: int = RUN, buckets: int = BUCKETS, size: int = CHUNK, seed: int = SEED) -> DataFrame:
    """doc_id, words, n_features, weight, score, rank (of those drawn) of every row of ``docs`` (doc_id, text).

    ``target``: a frame with a text column, whose distribution is wanted. All whole
    texts of both count.
    """
    if not 0 < buckets <= 65_536 or run < 1:
        raise ValueError("1 to 65536 buckets, and runs of one word at least")
    spark = docs.sparkSession
    store = Store(spark, "resampling")
    chunked = store.keep(chunks(docs, run, buckets, size), "chunks")
    wanted = counts(chunks(target.select(F.lit(0).alias("doc_id"), "text"), run, buckets, size), buckets)
    weighed = weigh(chunked, gains(counts(chunked, buckets), wanted))
    scored = store.keep(weighed.withColumn("score", F.col("weight") + noise(seed)), "scored")
    store.drop("chunks")
    may = F.col("words") >= least_words
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("place")]  # places part rows that are equal
    ranged = scored.where(may).withColumn("place", F.monotonically_increasing_id()).repartitionByRange(tasks(spark), *order).sortWithinPartitions(*order)
    ordered = store.keep(ranged.withColumn("at", F.monotonically_increasing_id()).drop("place"), "ordered")
    part = F.shiftright("at", 33)
    sizes = sorted((r.part, r.n) for r in ordered.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    drawn = percent * sum(n for _, n in sizes) // 100
    before, offsets = 0, []
    for p, n in sizes:
        offsets.append((p, before))
        before += n
    held = F.broadcast(spark.createDataFrame(offsets, "part long, before long"))
    place = F.col("before") + F.col("at") - F.shiftleft("part", 33) + 1
    ranked = ordered.withColumn("part", part).join(held, "part").withColumn("rank", F.when(place <= drawn, place))
    columns = ["doc_id", "words", "n_features", "weight", "score", "rank"]
    return ranked.select(*columns).unionByName(scored.where(~may).withColumn("rank", F.lit(None).cast("long")).select(*columns))


def sample(docs: DataFrame, ranked: DataFrame) -> DataFrame:
    """The rows whose id was drawn."""
    return docs.join(ranked.where("rank is not null").select("doc_id"), "doc_id", "left_semi")
