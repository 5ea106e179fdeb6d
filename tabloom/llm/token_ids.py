"""Token ids of a corpus in a compact binary form.

Ids are ranked by frequency and written in a byte-aligned variable-length
code: a rank takes one to four bytes, and its byte count two bits of a separate
control stream. Readers decode whole blocks by numpy table lookup.

Format. A folder with two tables. ``ranks``: (rank int, id int), the permutation
by falling frequency. ``blocks``: one row for each run of documents of a shard,
with columns

  shard int        part of the id range of documents; shards ascend in doc_id
  shard_start long ids in the same shard before this block
  n_tokens long    ids in this block
  doc_ids          binary, signed 64-bit little-endian, with ``nulls``
  nulls            binary, a byte 1 for each null doc_id
  counts           binary, unsigned 32-bit little-endian: ids of each document
  control          binary: each document's byte counts less one, four to a byte
                   from the low bits, padded with zeros to a whole byte
  data             binary: each rank's bytes, little-endian, without padding

Blocks are rows of Parquet, so that Spark's commit protocol makes a lost task
leave nothing behind, and any store that Spark reaches can hold them. Lengths
can be read without control or data.

Defined results: a null text is empty and gives the end id alone; documents are
in ascending doc_id order, null first, equal ids in the order of their texts'
hashes; an empty table gives no blocks. Columns beyond doc_id and text are not
stored.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.llm.common import Store, parts, take_worker, tasks, texts

END_ID = 1
#: Ids after which a block is closed.
BLOCK = 1 << 20
#: Distinct chunks, words of them included, whose ids a worker remembers.
REMEMBERED = 600_000
#: Bytes of texts after which a worker looks whether it remembers too many.
STEP = 4_000_000

_workers: dict[str, Encoder] = {}

#: Byte counts of the four ranks of a control byte.
LENGTHS = (np.arange(256)[:, None] >> np.arange(0, 8, 2) & 3).astype(np.uint8) + np.uint8(1)
_MASKS = np.array([0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)

#: Letters that lower case maps one to one and normalisation leaves, then marks: two words for the tokenizer.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-įı-ſ]+)([!-&(-/:-@\[-`{-~]*)\Z")


def _byte_letters() -> str:
    """The letter that stands for each byte in byte-level vocabularies: itself if visible in Latin-1, else from 256 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = iter(range(0x100, 0x200))
    return "".join(chr(b) if b in visible else chr(next(other)) for b in range(256))


class Encoder(dict):
    """The tokenizer, with the ids of chunks between ASCII white space remembered.

    The tokenizer's words never reach over white space, so a text's ids are its
    chunks' ids in a row. Chunks of plain letters and marks are two words at
    most, which go straight to the tokenizer's model; all others take its whole way.
    A word in small letters is its own chunk. A chunk with capitals or marks is
    remembered from when its word is known, as most words of a corpus occur once.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size()
        self.dtype = "<u2" if self.size <= 1 << 16 else "<u4"
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        self.marks: dict[str, bytes] = {}
        probe = "Probé, these: ÉÀß?!"
        plain = b"".join(self._plain(*_PLAIN.match(c).groups()) for c in probe.split())
        #: whether words by way of the model are this tokenizer's words
        self.direct = plain == np.array(self.tokenizer.encode(probe, add_special_tokens=False).ids, self.dtype).tobytes()

    @staticmethod
    def of(path: str) -> Encoder:
        if path not in _workers:
            _workers[path] = Encoder(path)
        take_worker("tokens", _workers.clear)
        return _workers[path]

    def _word(self, word: str) -> bytes:
        own = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
        return array("H" if self.dtype == "<u2" else "I", [t.id for t in self.model.tokenize(own)]).tobytes()

    def _plain(self, letters: str, marks: str) -> bytes:
        ids = self._word(letters.lower())
        return ids + self._word(marks) if marks else ids

    def __missing__(self, chunk: bytes) -> bytes:
        text = chunk.decode()
        if not self.direct or not (plain := _PLAIN.match(text)):
            ids = self[chunk] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()
            return ids
        letters, marks = plain.groups()
        small = letters.lower()
        word = small.encode()
        known = self.get(word)
        ids = known
        if ids is None:
            ids = self[word] = self._word(small)
        if marks:
            end = self.marks.get(marks)
            if end is None:
                end = self.marks[marks] = self._word(marks)
            ids += end
        if known is not None:
            self[chunk] = ids
        return ids

    def encode(self, batch: list[bytes]) -> list[bytes]:
        """Ids of each text as unsigned little-endian integers of ``dtype``."""
        out = [b"".join(map(self.__getitem__, text.split())) for text in batch]
        for known in (self, self.marks):
            if len(known) > REMEMBERED:
                known.clear()
        return out


def _ids_only() -> None:
    """To be called in a task that reads ids, not texts: the worker's tokenizer goes, with the words it remembered."""
    take_worker("token ids")


def pack(ranks: np.ndarray, counts: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data of documents whose ranks follow each other."""
    ranks = ranks.astype("<u4", copy=False)
    size = 1 + (ranks > 0xFF) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    padded, place = _places(counts)
    codes = np.zeros(padded, np.uint8)
    codes[place] = size - 1
    control = (codes.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1, dtype=np.uint8)
    data = ranks.view(np.uint8).reshape(-1, 4)[np.arange(4) < size[:, None]]
    return control.tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, counts: np.ndarray) -> np.ndarray:
    """The ranks again: byte counts by table lookup, then one gather."""
    _, place = _places(counts)
    size = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[place].astype(np.int64)
    end = np.cumsum(size)
    raw = np.frombuffer(data + b"\0\0\0", np.uint8)
    words = np.lib.stride_tricks.as_strided(raw, (max(len(raw) - 3, 0), 4), (1, 1))
    return np.ascontiguousarray(words[end - size]).view("<u4").reshape(-1) & _MASKS[size - 1]


def _places(counts: np.ndarray) -> tuple[int, np.ndarray]:
    """Length of the padded code sequence, and where in it each rank's code is."""
    counts = counts.astype(np.int64)
    padded = (counts + 3) // 4 * 4
    starts, before = np.cumsum(padded) - padded, np.cumsum(counts) - counts
    return int(padded.sum()), np.arange(int(counts.sum())) + np.repeat(starts - before, counts)


def tokenise(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID) -> DataFrame:
    """doc_id, tie (a hash of the text), ids (of the encoder's dtype, with the end) of each document; no shuffle."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("tie", F.xxhash64("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(tokenizer_path)
        end = np.array([end_id], encoder.dtype).tobytes()
        for batch in batches:
            ids = [x + end for some in parts(texts(batch, "text"), STEP) for x in encoder.encode(some)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tie"), pa.array(ids, pa.binary())], names=["doc_id", "tie", "ids"])

    return docs.mapInArrow(run, "doc_id long, tie long, ids binary")


def frequencies(tokens: DataFrame, size: int, dtype: str) -> np.ndarray:
    """How often each id occurs; the driver gets one number for each id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _ids_only()
        total = np.zeros(size, np.int64)
        for batch in batches:
            for some in parts(batch.column("ids").to_pylist()):
                total += np.bincount(np.frombuffer(b"".join(some), dtype), minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["id", "n"])

    total = np.zeros(size, np.int64)
    for r in tokens.select("ids").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        total[r.id] = r.n
    return total


_BLOCKS = "shard int, shard_start long, n_tokens long, doc_ids binary, nulls binary, counts binary, control binary, data binary"


def write(docs: DataFrame, tokenizer_path: str, out: str, end_id: int = END_ID, shards: int | None = None) -> None:
    """Writes the corpus to ``out``.

    Texts are tokenised once; counting ids and finding the bounds of the shards
    read the tokens. Then coded documents move once, to their shard.
    """
    spark, store = docs.sparkSession, Store(docs.sparkSession, "tokens")
    encoder = Encoder.of(tokenizer_path)
    dtype, size = encoder.dtype, max(encoder.size, end_id + 1)
    tokens = store.keep(tokenise(docs, tokenizer_path, end_id), "tokens")
    total = frequencies(tokens, size, dtype)
    order = np.lexsort((np.arange(size), -total))
    spark.createDataFrame(pa.table({"rank": np.arange(size, dtype=np.int32), "id": order.astype(np.int32)})).coalesce(1).write.parquet(f"{out}/ranks")
    rank_of = np.empty(size, np.uint32)
    rank_of[order] = np.arange(size, dtype=np.uint32)
    shards = shards or tasks(spark)
    cuts = tokens.agg(F.percentile_approx("doc_id", [i / shards for i in range(1, shards)], 20 * shards)).first()[0] if shards > 1 else None
    held = spark.sparkContext.broadcast((rank_of, np.unique(np.array(cuts or [], np.int64))))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _ids_only()
        ranks, cuts = held.value
        for batch in batches:
            ids = batch.column("ids").to_pylist()
            counts = np.fromiter(map(len, ids), np.int64, len(ids)) // np.dtype(dtype).itemsize
            coded = [pack(ranks[np.frombuffer(x, dtype)], n) for x, n in zip(ids, counts[:, None], strict=True)]
            place = np.searchsorted(cuts, batch.column("doc_id").fill_null(-(1 << 63)).to_numpy(), "left")
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(place.astype(np.int32)),
                    batch.column("doc_id"),
                    batch.column("tie"),
                    pa.array(counts),
                    pa.array([c for c, _ in coded], pa.binary()),
                    pa.array([d for _, d in coded], pa.binary()),
                ],
                names=["part", "doc_id", "tie", "n", "control", "data"],
            )

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _ids_only()
        shard, start = TaskContext.get().partitionId(), 0
        ids, counts, control, data = [], [], [], []

        def close() -> pa.RecordBatch:
            nonlocal start
            n, nulls = sum(counts), bytes(i is None for i in ids)
            row = [shard, start, n, np.array([i or 0 for i in ids], "<i8").tobytes(), nulls, np.array(counts, "<u4").tobytes(), b"".join(control), b"".join(data)]
            start += n
            for x in (ids, counts, control, data):
                x.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array([v], t) for v, t in zip(row, [pa.int32(), pa.int64(), pa.int64()] + [pa.binary()] * 5, strict=True)],
                names=["shard", "shard_start", "n_tokens", "doc_ids", "nulls", "counts", "control", "data"],
            )

        held = 0
        for batch in batches:
            for i, n, c, d in zip(*(batch.column(x).to_pylist() for x in ("doc_id", "n", "control", "data")), strict=True):
                ids.append(i)
                counts.append(n)
                control.append(c)
                data.append(d)
                held += n
                if held >= BLOCK:
                    yield close()
                    held = 0
        if ids:
            yield close()

    coded = tokens.mapInArrow(code, "part int, doc_id long, tie long, n long, control binary, data binary")
    ranged = coded.repartitionById(shards, "part").sortWithinPartitions("doc_id", "tie")
    ranged.mapInArrow(block, _BLOCKS).write.option("compression", "none").parquet(f"{out}/blocks")
    store.drop()


def read(spark: SparkSession, out: str) -> DataFrame:
    """doc_id, start, n_tokens and ids (unsigned 32-bit little-endian bytes) of each document, from the files."""
    blocks = spark.read.schema(_BLOCKS).parquet(f"{out}/blocks")
    sizes = blocks.groupBy("shard").agg(F.sum("n_tokens").alias("n")).collect()  # a number for each shard
    before, total = {}, 0
    for r in sorted(sizes, key=lambda r: r.shard):
        before[r.shard], total = total, total + r.n
    ranks = spark.read.parquet(f"{out}/ranks").toPandas()  # as long as the vocabulary
    id_of = np.empty(len(ranks), "<u4")
    id_of[ranks["rank"]] = ranks["id"]
    held = spark.sparkContext.broadcast((before, id_of))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _ids_only()
        before, id_of = held.value
        for batch in batches:
            for i in range(batch.num_rows):  # a block at a time
                row = batch.slice(i, 1).to_pylist()[0]
                counts = np.frombuffer(row["counts"], "<u4").astype(np.int64)
                ids = id_of[unpack(row["control"], row["data"], counts)]
                end = np.cumsum(counts)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.frombuffer(row["doc_ids"], "<i8"), mask=np.frombuffer(row["nulls"], np.uint8) != 0),
                        pa.array(before[row["shard"]] + row["shard_start"] + end - counts),
                        pa.array(counts),
                        pa.array([ids[e - n : e].tobytes() for e, n in zip(end.tolist(), counts.tolist(), strict=True)], pa.binary()),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids"],
                )

    return blocks.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def digest(read_back: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the ids' unsigned crc32."""
    return read_back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def round_trip(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID) -> DataFrame:
    """Writes ``docs`` in the shared folder, reads the files back, and gives each document's digest."""
    store = Store(docs.sparkSession, "token-ids")
    write(docs, tokenizer_path, store.root, end_id)
    return digest(read(docs.sparkSession, store.root))


def crc(ids: list[int]) -> int:
    return zlib.crc32(np.array(ids, "<u4").tobytes())
