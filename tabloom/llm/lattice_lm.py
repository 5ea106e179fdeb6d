"""Subword lattice likelihood: probability of a text over all its segmentations.

An existing subword vocabulary gives the pieces and, by its scores, their first
weights (``vocabulary`` states the map). A word's spelling probability sums
over every segmentation into pieces, by a forward recursion in log space over its
bytes; single bytes are pieces too, so that no word has probability zero. The
weights are learned: in each of ``ROUNDS`` passes over the training rows' distinct
words, a piece's new weight is how often it is expected in their segmentations
(forward and backward recursion), plus its first weight times ``PRIOR``.

A training word is a piece of its own as well, the whole word: of its count c, a
discount D goes to spelling, so that a word's probability is
(max(c - D, 0) + D * types * spelling) / words, over the training rows' words and
distinct words (types); D = (n1 + 1) / (n1 + 2 * n2 + 2), with n1 and n2 the words
that occur once and twice. The probabilities of all words sum to 1.

After each word the text goes on or ends: the probability of the end is
(ends + 1) / (tokens + 2) in the training rows. A text's probability is the
product of its words', of going on before each, and of the end.

Beside it stands a base model, additive smoothing of whole words.

Defined results: a null text is empty, and holds only its end; repeated rows
and ids are scored row by row; a null id is in training; without any training
word spelling alone, by the first weights, is a word's probability; without any
training row the counts are zero and a text ends with probability 1/2. Columns
beyond doc_id and text are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import Store, cut_at, take_worker, texts

#: Most frequent words that are broadcast with their scores; all others are joined.
HOT_WORDS = 100_000
#: Distinct words that a task gathers before it sends their counts on.
FLUSH = 400_000
SMOOTHING = 0.1
#: Passes over the training words that learn the pieces' weights.
ROUNDS = 2
#: Pieces that the first weights count for in each pass.
PRIOR = 100
#: Added to a piece's rank where a file's scores are ranks.
RANK_SHIFT = 10
#: Longer words take the plain recursion; shorter ones are done many at once.
_MANY = 96
_NONE = -1e30


def vocabulary(path: str) -> list[tuple[bytes, float]]:
    """Pieces (a space stands for the word start) with their probabilities.

    A file's scores are natural log probabilities, and e to the score is a piece's
    weight; where all of them are whole numbers they are ranks (0, -1, -2, ...), and
    a piece weighs 1 / (RANK_SHIFT - score), the law of word frequencies. Single bytes
    without a piece weigh as much as the lightest one. Weights are scaled to sum 1.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    scored: dict[bytes, float] = {}
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i):
            continue
        piece = model.id_to_piece(i).replace("▁", " ").encode()
        if b" " not in piece[1:]:
            scored[piece] = model.get_score(i)
    ranks = all(x == int(x) and x <= 0 for x in scored.values())
    weight = {p: 1 / (RANK_SHIFT - x) if ranks else math.exp(x) for p, x in scored.items()}
    least = min(weight.values(), default=1.0)
    for b in range(256):
        weight.setdefault(bytes([b]), least)
    total = sum(weight.values())
    return [(p, w / total) for p, w in weight.items()]


class Lattice:
    """Pieces with log probabilities, and the forward recursion over words."""

    _BASE = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, pieces: list[bytes], logp: np.ndarray):
        self.pieces, self.logp = pieces, np.asarray(logp, float)
        self.longest = max(map(len, pieces))
        self.index = {p: i for i, p in enumerate(pieces)}
        self.bits = max(10, (4 * len(pieces)).bit_length())
        self._table()

    def _hash(self, data: bytes) -> int:
        h = 0
        for b in data:
            h = (h * int(self._BASE) + b + 1) & 0xFFFFFFFFFFFFFFFF
        return h

    def _table(self) -> None:
        size = 1 << self.bits
        self.keys, self.values = np.zeros(size, np.uint64), np.full(size, -1, np.int32)
        self.probes = 1
        for i, p in enumerate(self.pieces):
            h = self._hash(p)
            at = ((h * 0xD6E8FEB86659FD93) & 0xFFFFFFFFFFFFFFFF) >> (64 - self.bits)
            n = 1
            while self.values[at] >= 0:
                at, n = (at + 1) % size, n + 1
            self.keys[at], self.values[at] = h, i
            self.probes = max(self.probes, n)

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """Piece indexes, -1 where there is none."""
        at = ((hashes * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - self.bits)).view(np.int64)
        out = self.values[at]
        # most slots are empty, or hold the piece itself; few are looked up further on
        todo = np.flatnonzero((out >= 0) & (self.keys[at] != hashes))
        at = at[todo]
        out[todo] = -1
        for _ in range(self.probes - 1):
            at = (at + 1) & ((1 << self.bits) - 1)
            slot = self.values[at]
            same = (self.keys[at] == hashes[todo]) & (slot >= 0)
            out[todo[same]] = slot[same]
            more = ~same & (slot >= 0)
            todo, at = todo[more], at[more]
            if not len(todo):
                break
        return out

    def _edges(self, block: np.ndarray) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
        """For words of one length: (start, end) to the rows that have a piece there, and the pieces."""
        n, size = block.shape
        pre = np.zeros((size + 1, n), np.uint64)
        for i in range(size):
            pre[i + 1] = pre[i] * self._BASE + block[:, i].astype(np.uint64) + np.uint64(1)
        powers = [np.uint64(1)]
        for _ in range(self.longest):
            powers.append(np.uint64((int(powers[-1]) * int(self._BASE)) & 0xFFFFFFFFFFFFFFFF))
        out = {}
        for j in range(1, size + 1):
            for i in range(max(0, j - self.longest), j):
                found = self._find(pre[j] - pre[i] * powers[j - i])
                rows = np.flatnonzero(found >= 0)
                if len(rows):
                    out[i, j] = rows, found[rows]
        return out

    def _blocks(self, words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Row numbers and bytes (with the word start) of words of one length."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(sizes, kind="stable")
        for size in np.unique(sizes):
            rows = order[np.searchsorted(sizes[order], size) : np.searchsorted(sizes[order], size, "right")]
            if size > _MANY:
                continue
            step = max(256, 400_000 // (int(size) + 1))
            for a in range(0, len(rows), step):
                part = rows[a : a + step]
                raw = np.frombuffer(b"".join(b" " + words[r] for r in part), np.uint8)
                yield part, raw.reshape(len(part), int(size) + 1)

    def forward(self, words: list[bytes]) -> np.ndarray:
        """Natural log of each word's marginal probability."""
        out = np.empty(len(words))
        for rows, block in self._blocks(words):
            alpha = self._alpha(block.shape, self._edges(block))
            out[rows] = alpha[-1]
        for r, w in enumerate(words):
            if len(w) > _MANY:
                out[r] = self._plain(b" " + w)[-1]
        return out

    def expected(self, words: list[bytes]) -> np.ndarray:
        """How often each piece is expected in one segmentation of every word, drawn by probability."""
        out = np.zeros(len(self.pieces))
        for _, block in self._blocks(words):
            edges = self._edges(block)
            alpha = self._alpha(block.shape, edges)
            beta = np.full(alpha.shape, _NONE)
            beta[-1] = 0
            for (i, j), (rows, found) in reversed(edges.items()):  # ends descend
                on = beta[j, rows] + self.logp[found]
                beta[i, rows] = np.logaddexp(beta[i, rows], on)
                out += np.bincount(found, np.exp(alpha[i, rows] + on - alpha[-1, rows]), len(out))
        for w in words:
            if len(w) > _MANY:
                self._plain_expected(b" " + w, out)
        return out

    def _plain_expected(self, word: bytes, out: np.ndarray) -> None:
        alpha, size = self._plain(word), len(word)
        beta = [0.0] * (size + 1)
        for i in range(size - 1, -1, -1):
            edges = [(j, k) for j in range(i + 1, min(size, i + self.longest) + 1) if (k := self.index.get(word[i:j])) is not None]
            terms = [beta[j] + self.logp[k] for j, k in edges]
            top = max(terms)
            beta[i] = top + math.log(sum(math.exp(t - top) for t in terms))
            for (_, k), t in zip(edges, terms, strict=True):
                out[k] += math.exp(alpha[i] + t - alpha[-1])

    def _alpha(self, shape: tuple[int, int], edges: dict) -> np.ndarray:
        n, size = shape
        alpha = np.full((size + 1, n), _NONE)
        alpha[0] = 0
        for (i, j), (rows, found) in edges.items():  # ends ascend
            alpha[j, rows] = np.logaddexp(alpha[j, rows], alpha[i, rows] + self.logp[found])
        return alpha

    def _plain(self, word: bytes) -> list[float]:
        alpha = [0.0]
        for j in range(1, len(word) + 1):
            terms = [alpha[i] + self.logp[k] for i in range(max(0, j - self.longest), j) if (k := self.index.get(word[i:j])) is not None]
            top = max(terms)
            alpha.append(top + math.log(sum(math.exp(t - top) for t in terms)))
        return alpha


def words(text: bytes) -> list[bytes]:
    """A-Z lower-cased, split at spaces and bytes 9 to 13."""
    return text.lower().split()


def count_words(docs: DataFrame, train: Column) -> DataFrame:
    """word, c (in training rows), a (in all rows), gathered by task before the shuffle.

    The empty word counts the ends.
    """
    rows = docs.select("text", train.alias("train"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_worker("lattice")
        seen: dict[bool, Counter] = {True: Counter(), False: Counter()}

        def flush() -> pa.RecordBatch:
            every = list(seen[True] | seen[False])
            c = [seen[True].get(w, 0) for w in every]
            a = [x + seen[False].get(w, 0) for w, x in zip(every, c, strict=True)]
            for s in seen.values():
                s.clear()
            return pa.RecordBatch.from_arrays([pa.array(every, pa.binary()), pa.array(c, pa.int64()), pa.array(a, pa.int64())], names=["word", "c", "a"])

        for batch in batches:
            for text, train in zip(texts(batch, "text"), batch.column("train").to_pylist(), strict=True):
                own = seen[train]
                own.update(words(text))
                own[b""] += 1
                if len(seen[True]) + len(seen[False]) > FLUSH:
                    yield flush()
        yield flush()

    return rows.mapInArrow(run, "word binary, c long, a long").groupBy("word").agg(F.sum("c").alias("c"), F.sum("a").alias("a"))


def word_chance(total: int, types: int, once: int, twice: int) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """From words' training counts and natural logs of spelling to natural logs of probability."""
    if not total:
        return lambda c, spelt: spelt
    discount = (once + 1) / (once + 2 * twice + 2)

    def run(c: np.ndarray, spelt: np.ndarray) -> np.ndarray:
        spelt = spelt + math.log(discount * types)
        # a word that is not known may be spelt with less than the least double
        return np.where(c > 0, np.log(np.where(c > 0, c - discount + np.exp(spelt), 1)), spelt) - math.log(total)

    return run


def gathered(batches: Iterator[pa.RecordBatch], rows: int = 150_000) -> Iterator[pa.Table]:
    """Batches put together to so many rows, for array operations that are worth their call."""
    some, n = [], 0
    for batch in batches:
        some.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield pa.Table.from_batches(some)
            some, n = [], 0
    if n:
        yield pa.Table.from_batches(some)


def learned(known: DataFrame, lattice: Lattice, rounds: int = ROUNDS) -> Lattice:
    """The lattice with weights learned from column ``word``; the driver gets a number for each piece and round."""
    first = np.exp(lattice.logp)
    for _ in range(rounds):
        held = known.sparkSession.sparkContext.broadcast(lattice)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            take_worker("lattice")
            n = np.zeros(len(held.value.pieces))
            for table in gathered(batches):
                n += held.value.expected(table.column("word").to_pylist())
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(n[at])], names=["piece", "n"])

        weight = PRIOR * first
        for r in known.select("word").mapInArrow(run, "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect():
            weight[r.piece] += r.n
        lattice = Lattice(lattice.pieces, np.log(weight / weight.sum()))
        held.unpersist()
    return lattice


def score(docs: DataFrame, vocabulary_path: str, held_out: Column, hot: int = HOT_WORDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.

    The ``hot`` most frequent words travel by broadcast (a bound on its size);
    every other word meets its counts and its lattice score in a join by word.
    """
    spark, store = docs.sparkSession, Store(docs.sparkSession, "lattice-lm")
    docs = docs.select("doc_id", "text", F.coalesce(held_out, F.lit(False)).alias("held_out"))
    counts = store.keep(count_words(docs, ~F.col("held_out")), "counts")
    n, v = counts.where("c > 0").agg(F.sum("c"), F.count("c")).first()
    n = n or 0
    real = counts.where("word != x''")
    end_row = counts.where("word = x''").first()
    ends = end_row.c if end_row else 0
    pieces, chances = zip(*vocabulary(vocabulary_path), strict=True)
    lattice, end = Lattice(list(pieces), np.log(chances)), (ends + 1) / (n + 2)
    if n > ends:
        lattice = learned(real.where("c > 0"), lattice)
    once, twice = real.agg(*(F.count_if(F.col("c") == k) for k in (1, 2))).first()
    chance = word_chance(n - ends, v - int(ends > 0), once, twice)

    common = real.where(F.col("a") >= cut_at(real, "a", hot)).collect()
    keys = [bytes(r.word) for r in common]
    log10 = 1 / math.log(10)
    of_c = np.log10(np.array([r.c for r in common], float) + SMOOTHING)
    of_lattice = chance(np.array([r.c for r in common], float), lattice.forward(keys)) * log10 if keys else np.zeros(0)
    frequent = spark.sparkContext.broadcast(({k: i for i, k in enumerate(keys)}, of_c, of_lattice, np.array([r.c > 0 for r in common], bool)))
    held = spark.sparkContext.broadcast(lattice)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each document, under a word that can't be joined, and one for each of its rarer words."""
        take_worker("lattice")
        index, logs, lats, known = frequent.value
        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            key, word, tf, head = [], [], [], []
            for text in texts(batch, "text"):
                ws = words(text)
                at = np.fromiter(map(index.get, ws, repeat(-1)), np.int64, len(ws))
                mine = at[at >= 0]
                rare = Counter([ws[i] for i in np.flatnonzero(at < 0)])
                key.append(row)
                word.append(b" %d" % row)
                tf.append(len(ws))
                head.append((len(key) - 1, logs[mine].sum(), lats[mine].sum(), int(known[mine].sum())))
                key.extend(repeat(row, len(rare)))
                word.extend(rare)
                tf.extend(rare.values())
                row += 1
            size, places = len(key), [h[0] for h in head]
            base, lat, hits = np.zeros(size), np.zeros(size), np.zeros(size, np.int64)
            ids, out = np.zeros(size, np.int64), np.zeros(size, bool)
            nulls, heads = np.ones(size, bool), np.zeros(size, bool)
            heads[places] = True
            base[places], lat[places], hits[places] = [h[1] for h in head], [h[2] for h in head], [h[3] for h in head]
            doc = batch.column("doc_id")
            ids[places] = doc.fill_null(0).to_numpy(zero_copy_only=False)
            nulls[places] = doc.is_null().to_numpy(zero_copy_only=False)
            out[places] = batch.column("held_out").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key, pa.int64()), pa.array(word, pa.binary()), pa.array(tf, pa.int64()), pa.array(heads), pa.array(ids, mask=nulls), pa.array(out), pa.array(base), pa.array(lat), pa.array(hits)],
                names=["key", "word", "tf", "head", "doc_id", "held_out", "base", "lat", "known"],
            )

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in gathered(batches):
            lat = chance(table.column("c").to_numpy().astype(float), held.value.forward(table.column("word").to_pylist())) * log10
            yield from table.append_column("word_lat", pa.array(lat)).to_batches()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "held_out").mapInArrow(
        gather, "key long, word binary, tf long, head boolean, doc_id long, held_out boolean, base double, lat double, known long"
    )
    table = real.select("word", "c").mapInArrow(weigh, "word binary, c long, word_lat double")
    tf, c = F.col("tf"), F.col("c")
    summed = (
        rows.join(table, "word", "left")
        .groupBy("key")
        .agg(
            F.max("doc_id").alias("doc_id"),
            F.max("held_out").alias("held_out"),
            F.sum(F.when(F.col("head"), tf + 1)).alias("n_tokens"),
            F.sum(F.when(F.col("head"), F.col("known")).when(c > 0, tf).otherwise(0)).alias("n_known"),
            F.sum(F.when(F.col("head"), F.col("base")).otherwise(tf * F.log10(c + SMOOTHING))).alias("base"),
            F.sum(F.when(F.col("head"), F.col("lat")).otherwise(tf * F.col("word_lat"))).alias("lat"),
        )
    )
    return summed.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + int(ends > 0)).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + math.log10(ends + SMOOTHING) - F.col("n_tokens") * math.log10(n + SMOOTHING * (v + 1))).alias("base_score"),
        (F.col("lat") + (F.col("n_tokens") - 1) * math.log10(1 - end) + math.log10(end)).alias("score"),
    )
