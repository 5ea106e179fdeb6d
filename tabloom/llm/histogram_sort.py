"""Sharding by histogram sort.

Rows have a total order by a 64-bit hash of their text and, within equal texts,
by doc_id. Shards are runs of that order with equal bytes. Their splitters are
found by counting: each round, all partitions count the exact bytes and rows
below candidate boundaries, the boundaries around each splitter's target close
in, and rounds end when a boundary meets the tolerance or when no further key
lies between. Only then rows move, once, each straight to its place.

A large shard is sorted in pieces, on which no law is laid: its key range is cut
in equal parts and counted once, and only parts that turn out large (a hot text,
ids that lie close) are cut again. So the driver sees a few numbers for each
probe of a shard's splitter, and after that five dozen bytes for each piece and round, as
columns; what tasks look up is 24 bytes for each piece (9 MB at 100 TB).

Rows that are equal in both keys are told apart only where a splitter needs it,
because they hold more bytes than the tolerance or two pieces leave: rows of such
keys (one for each splitter or piece at most) are stored, and their place in the stored files is a
third key.

Defined results: a null text counts as empty, a null doc_id sorts first; rows
equal in both keys may be in several shards; an empty table gives no rows. Copies
of a text are neighbours, in one shard unless a boundary falls among them. All
columns pass through; columns of the same names as the added ones give way.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import Store, fresh

OVERHEAD = 16
#: Allowed distance of a splitter from its target, as a part of a shard's bytes.
TOLERANCE = 0.0005
#: Candidate boundaries for each splitter and round.
PROBES = 12
#: Shards of more than twice as many bytes are sorted in pieces of about so many.
PIECE = 256 << 20

_SHIFT = 1 << 63


def size_of(text: str = "text") -> Column:
    """UTF-8 bytes and a fixed overhead."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long")


Key = tuple[int, int, int]


def _number(key: Key) -> int:
    """The three signed keys as one number in the same order."""
    h, d, t = key
    return ((h + _SHIFT) << 128) + ((d + _SHIFT) << 64) + t + _SHIFT


def _keys(number: int) -> Key:
    low = (1 << 64) - 1
    return (number >> 128) - _SHIFT, ((number >> 64) & low) - _SHIFT, (number & low) - _SHIFT


def place(h: np.ndarray, d: np.ndarray, t: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How many of the ascending bounds (rows of three keys) are at or below each row's keys."""
    low, high = np.searchsorted(bounds[:, 0], h, "left"), np.searchsorted(bounds[:, 0], h, "right")
    tied = np.flatnonzero(low < high)
    if len(tied):
        # few rows share a bound's hash: these are sorted among the bounds, a bound before its equals
        rows = np.concatenate((bounds, np.stack((h[tied], d[tied], t[tied]), 1)))
        is_row = np.arange(len(rows)) >= len(bounds)
        order = np.lexsort((is_row, rows[:, 2], rows[:, 1], rows[:, 0]))
        below = np.cumsum(~is_row[order])
        at = order >= len(bounds)
        low[tied[order[at] - len(bounds)]] = below[at]
    return low


@dataclass
class Gaps:
    """Rows between neighbouring bounds, where there are any, in order; a column for each number."""

    bytes: np.ndarray
    rows: np.ndarray
    least: np.ndarray  #: three keys
    most: np.ndarray


@dataclass
class Splitters:
    bounds: list[Key]  #: ascending keys at which a shard begins
    rounds: int
    stuck: list[tuple[int, int]]  #: first two keys of rows that a splitter had to keep together


@dataclass
class Pieces:
    bounds: np.ndarray  #: ascending keys at which a piece begins, but for the first
    shard: np.ndarray
    offset: np.ndarray  #: rows of the shard's pieces before
    bytes: np.ndarray
    rounds: int
    stuck: list[tuple[int, int]]  #: first two keys of rows that a piece had to keep together


def _count(keys: DataFrame, bounds: np.ndarray) -> Gaps:
    """For each gap between bounds that has rows: bytes, rows, least and greatest key."""
    held = keys.sparkSession.sparkContext.broadcast(bounds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, d, t, size = (batch.column(c).to_numpy() for c in ("h", "d", "t", "size"))
            if not len(h):
                continue
            gap = place(h, d, t, held.value)
            order = np.lexsort((t, d, h, gap))
            gap, h, d, t, size = gap[order], h[order], d[order], t[order], size[order]
            first = np.flatnonzero(np.concatenate(([True], gap[1:] != gap[:-1])))
            last = np.append(first[1:], len(gap)) - 1
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(gap[first].astype(np.int32)),
                    pa.array(np.add.reduceat(size, first)),
                    pa.array(last - first + 1),
                    *(pa.array(x[at]) for at in (first, last) for x in (h, d, t)),
                ],
                names=["gap", "bytes", "n", "h0", "d0", "t0", "h1", "d1", "t1"],
            )

    found = keys.mapInArrow(run, "gap int, bytes long, n long, h0 long, d0 long, t0 long, h1 long, d1 long, t1 long")
    least, most = F.min(F.struct("h0", "d0", "t0")).alias("least"), F.max(F.struct("h1", "d1", "t1")).alias("most")
    got = found.groupBy("gap").agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n"), least, most).select("gap", "bytes", "n", "least.*", "most.*").toArrow()
    held.destroy()
    order = np.argsort(got["gap"].to_numpy())
    columns = {c: got[c].to_numpy()[order] for c in got.column_names}
    return Gaps(columns["bytes"], columns["n"], *(np.stack([columns[k + i] for k in "hdt"], 1) for i in "01"))


def _array(bounds: Iterable[Key]) -> np.ndarray:
    return np.array(list(bounds), np.int64).reshape(-1, 3)


def find_splitters(keys: DataFrame, shards: int, tolerance: float = TOLERANCE) -> Splitters:
    """Splitters of frame ``keys`` (h, d, t, size); the driver sees a few numbers for each candidate boundary."""
    whole = _count(keys, _array([]))
    if not len(whole.rows):
        return Splitters([], 0, [])
    total, rows = int(whole.bytes[0]), int(whole.rows[0])
    least, most = _number(whole.least[0].tolist()), _number(whole.most[0].tolist())
    targets = [total * i // shards for i in range(1, shards)]
    # for each target a bracket (key, bytes below, rows below) at its lower and upper end
    low = [(least, 0, 0)] * len(targets)
    high = [(most + 1, total, rows)] * len(targets)
    near = tolerance * total / shards

    def best(i: int) -> tuple[int, int, int]:
        return min(low[i], high[i], key=lambda b: (abs(b[1] - targets[i]), b[0]))

    rounds = 0
    while open_ := [i for i in range(len(targets)) if abs(best(i)[1] - targets[i]) > near and high[i][0] - low[i][0] > 1]:
        rounds += 1
        brackets = {(low[i][0], high[i][0]) for i in open_}
        probes = sorted({a + (b - a) * j // (PROBES + 1) for a, b in brackets for j in range(PROBES + 2)})
        gaps = _count(keys, _array(map(_keys, probes)))
        below, rows, known = 0, 0, []
        for size, n, first, last in zip(gaps.bytes.tolist(), gaps.rows.tolist(), gaps.least.tolist(), gaps.most.tolist(), strict=True):
            # the gap's own keys bound where a splitter can be
            known.append((_number(first), below, rows))
            below, rows = below + size, rows + n
            known.append((_number(last) + 1, below, rows))
        bytes_ = [k[1] for k in known]  # ascending, as the keys are
        for i in open_:
            if (at := bisect_right(bytes_, targets[i])) and known[at - 1][1:] >= low[i][1:]:
                low[i] = max(low[i], known[at - 1], key=lambda b: (b[1], b[0]))
            if (at := bisect_left(bytes_, targets[i])) < len(known):
                high[i] = min(high[i], known[at], key=lambda b: (b[1], b[0]))
            if low[i][1] == targets[i]:
                high[i] = low[i]
    ends = [best(i) for i in range(len(targets))]
    stuck = {_keys(low[i][0])[:2] for i, e in enumerate(ends) if abs(e[1] - targets[i]) > near}
    return Splitters([_keys(e[0]) for e in ends], rounds, sorted(stuck))


def cut(keys: DataFrame, splitters: list[Key], piece: int = PIECE) -> Pieces:
    """The shards between splitters in pieces of at most twice ``piece`` bytes, but for rows of equal keys."""
    starts = [_number(b) for b in splitters]
    bounds, rounds = set(starts), 0
    while True:
        gaps = _count(keys, _array(map(_keys, sorted(bounds))))
        rounds += 1
        large = np.flatnonzero(gaps.bytes > 2 * piece)
        one_key = (gaps.least[large] == gaps.most[large]).all(1)
        for g in large[~one_key].tolist():
            a, b = _number(gaps.least[g].tolist()), _number(gaps.most[g].tolist()) + 1
            parts = -(-int(gaps.bytes[g]) // piece)
            bounds |= {at for j in range(1, parts) if (at := a + (b - a) * j // parts) > a}  # one at least lies between
        if one_key.all():
            break
    stuck = {tuple(k) for k in gaps.least[large][:, :2].tolist()}
    shard = np.array([bisect_right(starts, _number(k)) for k in gaps.least.tolist()], np.int32)
    below = np.cumsum(gaps.rows) - gaps.rows
    first = np.flatnonzero(np.diff(shard, prepend=-1))  # of each shard that has rows
    offset = below - np.repeat(below[first], np.diff(first, append=len(shard)))
    return Pieces(gaps.least[1:], shard, offset, gaps.bytes, rounds, sorted(stuck))


def shard(docs: DataFrame, shards: int, tolerance: float = TOLERANCE, piece: int = PIECE) -> DataFrame:
    """All rows with size, shard (from 0) and slot (from 0 in each shard, gapless), in the order of both."""
    spark, store = docs.sparkSession, Store(docs.sparkSession, "histogram-sort")
    docs = docs.drop("size", "shard", "slot")
    h, d, t, part, at, of, offset = fresh(docs, "h", "d", "t", "part", "at", "of", "offset")
    rows = docs.withColumns({h: F.xxhash64(F.coalesce("text", F.lit(""))), d: F.coalesce(F.col("doc_id").cast("long"), F.lit(-_SHIFT))})

    def of_keys(df: DataFrame, third) -> DataFrame:
        return df.select(F.col(h).alias("h"), F.col(d).alias("d"), third.alias("t"), size_of().alias("size"))

    keys = store.keep(of_keys(rows, F.lit(0).cast("long")), "keys")
    found = find_splitters(keys, shards, tolerance)
    pieces = cut(keys, found.bounds, piece)
    rows = rows.withColumn(t, F.lit(0).cast("long"))
    # a key of a single row can't be split; only those of several are worth it
    stuck = sorted({*found.stuck, *pieces.stuck})
    tied = spark.createDataFrame(stuck, "h long, d long")
    if stuck and (many := keys.join(F.broadcast(tied), ["h", "d"]).groupBy("h", "d").count().where("count > 1").select("h", "d").collect()):
        tied = spark.createDataFrame(many, "h long, d long")
        on = F.broadcast(tied.select(F.col("h").alias(of), F.col("d").alias(at)))
        meet = (F.col(h) == F.col(of)) & (F.col(d) == F.col(at))
        split = store.keep(rows.join(on, meet, "left_semi").drop(t), "tied")
        split = split.withColumn(t, F.xxhash64("_metadata.file_name", "_metadata.row_index"))
        rows = rows.join(on, meet, "left_anti").unionByName(split)
        keys = keys.join(F.broadcast(tied), ["h", "d"], "left_anti").unionByName(of_keys(split, F.col(t)))
        keys = store.keep(keys, "keys-tied")
        pieces = cut(keys, find_splitters(keys, shards, tolerance).bounds, piece)
    store.drop("keys", "keys-tied")
    held, n = spark.sparkContext.broadcast(pieces.bounds), max(1, len(pieces.shard))

    @F.pandas_udf("int")
    def piece_of(h: pd.Series, d: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series(place(h.to_numpy(), d.to_numpy(), t.to_numpy(), held.value).astype(np.int32))

    # 16 bytes for each piece: 6 MB at 100 TB
    places = pa.table({part: np.arange(len(pieces.shard), dtype=np.int32), "shard": pieces.shard, offset: pieces.offset})
    moved = (
        rows.withColumn(part, piece_of(h, d, t))
        .repartitionById(n, part)
        .sortWithinPartitions(h, d, t)
        # a partition is a piece: its rows' numbers go on from the rows of the shard's pieces before
        .withColumn(at, F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    )
    return (
        moved.join(F.broadcast(spark.createDataFrame(places)), part)
        .withColumns({"size": size_of(), "slot": F.col(at) + F.col(offset)})
        .drop(h, d, t, part, at, offset)
    )
