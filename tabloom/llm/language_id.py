"""Language identification: averaged hashed subword embeddings and a linear softmax.

Each word gives its byte n-grams, hashed into buckets; a text's vector is the
mean of its n-grams' embeddings, a linear layer gives the languages' scores.
Both are trained together by stochastic gradient descent in numpy. Part of the
sample is kept apart: it sets the temperature of the probabilities, and the
probability and n-gram coverage below which a text is rejected.

The classifier is fitted on a bounded sample of labelled rows (``SAMPLE``, and
up to ``LEAST`` for each language, so that each one with a labelled text that has
words is learned; ``SAMPLE_BYTES`` of text in all, but one text of each language
at least). One task trains, and only the folded weights come to the driver.
Prediction takes every whole text of all rows.

Defined results: a text that is null or has no letter gets ``und`` with score 0
and is rejected; without any labelled text everything gets ``und``. Rows are
judged one by one, so ties, repeats and null ids change nothing; other columns
pass through.
"""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.llm.common import ALNUM, bound_batches, parts, take_worker, texts, with_fields

UND = "und"
#: Labelled rows that training takes, chosen by hash and dealt to the languages by their shares.
SAMPLE = 4_000
#: A language of a smaller share gives about so many rows all the same, or all that it has.
LEAST = 50
#: Bytes of text in the sample, dealt to the languages by their rows; a text beyond what its language has left is passed over.
SAMPLE_BYTES = 64_000_000
BUCKETS = 1 << 17
DIM = 16
GRAMS = (2, 3, 4)
EPOCHS = 5
#: Small samples are gone through more often, for so many steps at least.
STEPS = 12_000
RATE = 4.0
#: A fifth of the sample of each language calibrates.
CALIBRATE = 5
#: Part of the least calibration value below which a text is rejected.
MARGIN = 0.5
_REMEMBERED = 150_000
_HAS_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"


def grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the n-grams of all words between their marks: (length x place) buckets, which of them are whole, word starts."""
    raw = np.frombuffer(b"".join([b"<" + w + b">" for w in words]), np.uint8).astype(np.uint64) + np.uint64(1)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    ends = np.cumsum(sizes)
    left = np.repeat(ends, sizes) - np.arange(len(raw))
    found, whole = np.zeros((len(GRAMS), len(raw)), np.int64), np.zeros((len(GRAMS), len(raw)), bool)
    for g, n in enumerate(GRAMS):
        if len(raw) < n:
            continue
        h = np.full(len(raw) - n + 1, n, np.uint64)
        for i in range(n):
            h = (h ^ raw[i : len(raw) - n + 1 + i]) * np.uint64(0x100000001B3)
            h ^= h >> np.uint64(29)
        found[g, : len(h)] = (h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(47)
        whole[g] = left >= n
    return found, whole, ends - sizes


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(ALNUM).split()


def buckets(word: bytes) -> np.ndarray:
    """Buckets of one word's n-grams."""
    found, whole, _ = grams([word])
    return found[whole]


class Model:
    """The trained weights, folded: each bucket's scores, and whether training saw it."""

    def __init__(self, langs: list[str], table: np.ndarray, bias: np.ndarray, seen: np.ndarray):
        self.langs, self.table, self.bias, self.seen = langs, table, bias, seen
        self.temperature, self.least_score, self.least_seen = 1.0, 0.0, 0.0
        self._row: dict[bytes, int] = {}
        self._rows = np.zeros((0, len(langs) + 2))

    def __getstate__(self):
        return self.__dict__ | {"_row": {}, "_rows": self._rows[:0]}

    def forget(self) -> None:
        self._row, self._rows = {}, np.zeros((0, len(self.langs) + 2))

    def _places(self, words: list[bytes]) -> np.ndarray:
        """Rows of the words; unknown ones are summed from their n-grams, all at once."""
        new = [w for w in set(words) if w not in self._row]
        if len(self._row) + len(new) > _REMEMBERED:
            self._row.clear()
            self._rows = self._rows[:0]
            new = list(set(words))
        if new:
            n, k = len(self._row), len(self.langs)
            if n + len(new) > len(self._rows):
                self._rows = np.concatenate((self._rows, np.zeros((max(len(new), len(self._rows), 1024), k + 2))))
            for a in range(0, len(new), 20_000):
                some = new[a : a + 20_000]
                found, whole, starts = grams(some)
                each = np.zeros((found.shape[1], k + 2))
                for b, ok in zip(found, whole, strict=True):
                    each[ok, :k] += self.table[b[ok]]
                    each[ok, k + 1] += self.seen[b[ok]]
                each[:, k] = whole.sum(0)
                self._rows[n + a : n + a + len(some)] = np.add.reduceat(each, starts)
            self._row.update(zip(new, range(n, n + len(new)), strict=True))
        return np.fromiter(map(self._row.__getitem__, words), np.int64, len(words))

    def logits(self, batch: list[bytes]) -> list[tuple[np.ndarray, float] | None]:
        """For each text: scores of the languages, and the part of n-grams that training saw; None without words."""
        split = [text.translate(ALNUM).split() for text in batch]
        doc = np.repeat(np.arange(len(split)), np.fromiter(map(len, split), np.int64, len(split)))
        flat = list(chain.from_iterable(split))
        total = np.zeros((len(split), len(self.langs) + 2))
        for a in range(0, len(flat), 100_000):
            own = doc[a : a + 100_000]
            first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
            at = self._places(flat[a : a + 100_000])
            total[own[first]] += np.add.reduceat(self._rows[at], first)
        return [(t[:-2] / max(t[-2], 1) + self.bias, t[-1] / max(t[-2], 1)) if ws else None for t, ws in zip(total, split, strict=True)]

    def predict(self, batch: list[bytes]) -> list[tuple[str, float, bool]]:
        """For each text: language, calibrated probability, and whether to reject."""
        out = [(UND, 0.0, True)] * len(batch)
        asked = [i for i, text in enumerate(batch) if text and self.langs and any(c.isalpha() for c in text.decode())]
        for i, found in zip(asked, self.logits([batch[i] for i in asked]) if asked else (), strict=True):
            if found is not None:
                p = softmax(found[0] / self.temperature)
                best = int(p.argmax())
                out[i] = self.langs[best], float(p[best]), bool(p[best] < self.least_score or found[1] < self.least_seen)
        return out


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


def train(rows: Iterable[tuple[str, str]], seed: int = 7) -> Model:
    """Fits (text, language) rows; every fifth row of a language calibrates."""
    rows = [(t.encode(), lang) for t, lang in rows if t.strip()]
    rows = [r for r in rows if r[0].translate(ALNUM).strip()]
    langs = sorted({lang for _, lang in rows})
    if not langs:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0), np.zeros(BUCKETS, bool))
    apart, fitted, times = [], rows, Counter()
    if len(rows) > 20 * CALIBRATE:
        fitted = []
        for r in rows:
            times[r[1]] += 1
            (fitted if times[r[1]] % CALIBRATE else apart).append(r)
    rng = np.random.default_rng(seed)
    embed, linear, bias = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)), np.zeros((DIM, len(langs))), np.zeros(len(langs))
    ats, shares, ends, labels = [], [], [0], []
    for text, lang in fitted:
        if words := text.translate(ALNUM).split():
            found, whole, _ = grams(words)
            at, n = np.unique(found[whole], return_counts=True)
            ats.append(at.astype(np.int32))
            shares.append((n / n.sum()).astype(np.float32))
            ends.append(ends[-1] + len(at))
            labels.append(langs.index(lang))
    # two large arrays, which go back to the system at once
    ats, shares = np.concatenate(ats or [np.zeros(0, np.int32)]), np.concatenate(shares or [np.zeros(0, np.float32)])
    bags = [(ats[a:b], shares[a:b]) for a, b in zip(ends, ends[1:], strict=False)]
    seen = np.zeros(BUCKETS, bool)
    for at, _ in bags:
        seen[at] = True
    # rows of a language that has few come up more often
    have = np.bincount(labels, minlength=len(langs))
    turns = np.repeat(np.arange(len(bags)), [-(-LEAST // have[y]) for y in labels])
    epochs = max(EPOCHS, -(-STEPS // max(len(turns), 1)))
    steps, step = epochs * len(turns), 0
    for _ in range(epochs if bags else 0):
        for i in rng.permutation(turns):
            rate = RATE * (1 - step / steps)
            step += 1
            at, share = bags[i]
            mean = share @ embed[at]
            wrong = softmax(mean @ linear + bias)
            wrong[labels[i]] -= 1
            back = linear @ wrong
            linear -= rate * 0.25 * np.outer(mean, wrong)
            bias -= rate * 0.02 * wrong
            embed[at] -= rate * share[:, None] * back
    model = Model(langs, (embed @ linear).astype(np.float32), bias, seen)
    _calibrate(model, apart or fitted)
    return model


def _calibrate(model: Model, rows: list[tuple[bytes, str]]) -> None:
    rows = [r for r in rows if r[1] in model.langs]
    found = list(zip(model.logits([t for t, _ in rows]), [model.langs.index(lang) for _, lang in rows], strict=True)) if rows else []
    found = [(z[0], z[1], y) for z, y in found if z is not None]
    if not found:
        return
    z, y = np.array([f[0] for f in found]), np.array([f[2] for f in found])

    def loss(t: float) -> float:
        s = z / t
        top = s.max(1)
        return float((np.log(np.exp(s - top[:, None]).sum(1)) + top - s[np.arange(len(y)), y]).mean())

    model.temperature = float(min(np.geomspace(0.5, 20, 61), key=loss))
    p = np.array([softmax(x / model.temperature) for x in z])
    right = p.argmax(1) == y
    if right.any():
        model.least_score = max(1.05 / len(model.langs) if len(model.langs) > 1 else 0.0, MARGIN * float(p.max(1)[right].min()))
        model.least_seen = MARGIN * float(np.array([f[1] for f in found])[right].min())


def sample(docs: DataFrame, learn: Column, most: int = SAMPLE, least: int = LEAST) -> tuple[DataFrame, dict[str, int]]:
    """Labelled rows with words (h, lang, text, times), chosen by hash, and how many of each language training takes.

    Each language gives its share of ``most``, but ``least`` or more where it has
    them; so there are at most ``most`` rows and ``least`` for each language.
    The row of a language's smallest hash is always among them. What comes to the
    driver are counts by language.
    """
    h = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)).alias("h")
    rows = docs.where(learn & F.col("lang").isNotNull() & F.col("text").rlike(_HAS_WORD)).select("text", "lang", h)
    counts = rows.groupBy("lang").agg(F.count("*").alias("n"), F.min("h").alias("first")).collect()
    n = sum(r.n for r in counts)
    share = {r.lang: max(least, most * r.n // n) if n > most else r.n for r in counts}
    # in small numbers chance counts: more are asked for, and the first ones taken
    ends = [(r.lang, max(r.first + 1, int((1 << 30) * max(share[r.lang], 2 * least) / r.n)) if n > most else 1 << 30) for r in counts]
    few = docs.sparkSession.createDataFrame(ends, "lang string, end long")
    some = rows.join(F.broadcast(few), "lang").where("h < end")
    # rows that repeat come once, with their number
    return some.groupBy("lang", "h", "text").agg(F.count("*").alias("times")), share


def taken(rows: Iterable[tuple[str, str, int]], share: dict[str, int], most_bytes: int = SAMPLE_BYTES) -> Iterator[tuple[str, str]]:
    """(text, lang) of the first rows of each language, of (text, lang, times) in the order of their hashes."""
    left, every = dict(share), sum(share.values())
    room = {lang: most_bytes * n // every for lang, n in share.items()}
    begun = set()
    for text, lang, times in rows:
        size = len(text.encode())
        if left[lang] and (size <= room[lang] or lang not in begun):
            begun.add(lang)
            many = min(times, left[lang], max(1, room[lang] // max(size, 1)))
            left[lang] -= many
            room[lang] -= many * size
            yield from [(text, lang)] * many


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """The frame with lang_pred, score and rejected; one narrow pass over whole texts."""
    bound_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)
    schema = with_fields(docs, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType()))
    names = schema.names[:-3]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_worker("language", held.value.forget)
        for batch in batches:
            found = [x for some in parts(texts(batch, "text")) for x in held.value.predict(some)]
            lang, score, rejected = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in names), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())],
                names=schema.names,
            )

    return docs.mapInArrow(run, schema)


def fit(docs: DataFrame, learn: Column, most: int = SAMPLE, most_bytes: int = SAMPLE_BYTES) -> Model:
    """Trains in one task, which reads the bounded sample in the order of its hashes."""
    bound_batches(docs.sparkSession)
    rows, share = sample(docs, learn, most)
    if not share:
        return train([])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_worker("language training")
        each = ((r["text"], r["lang"], r["times"]) for batch in batches for a in range(0, batch.num_rows, 64) for r in batch.slice(a, 64).to_pylist())
        model = train(taken(each, share, most_bytes))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    one = rows.repartition(1).sortWithinPartitions("h", "lang", "text").select("text", "lang", "times")
    return pickle.loads(one.mapInArrow(run, "model binary").first().model)
