"""Benchmark decontamination with a generalised suffix automaton.

All normalised benchmark items go into one automaton over word ids. Training
texts stream through it; at each word it holds the length of the longest
passage, ending there, that occurs in any item. A word is hit when it lies in
an occurrence of ``window`` consecutive item words, or of a whole item that has
fewer.

States and transitions are flat arrays, about ``STATE_BYTES`` for each item word,
so ``AUTOMATON_WORDS`` bounds what is broadcast. A larger benchmark takes blocks of
items, one automaton each, and one automaton is in memory at a time. Documents are
stored once, and read once by a filter of hashes of all blocks' windows (once for each
``FILTER_WINDOWS`` of them); every block's pass reads the texts that have such a window
and writes the hits it finds, and these are put together.

Defined results: a null or empty text has no words and no hits; an item with
null text, or without words, takes no part; one with null id does where
``unnamed`` says so (as in op10 and the pipeline): its passages are hits, but it
is in no list of items; repeated items count once by id; columns beyond the named
ones pass through; an empty benchmark hits nothing.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.llm.common import ALNUM, Store, bound_batches, fresh, take_worker, texts, with_fields

WINDOW = 10
#: Words of items that one automaton holds; more items go into further automata, one pass each.
AUTOMATON_WORDS = 500_000
#: Words of items whose windows one filter holds, as hashes of 8 bytes (64 MB); more take further passes of filters.
FILTER_WINDOWS = 8_000_000
#: Bytes of an automaton for each word of its items, at most (a test holds it against this).
STATE_BYTES = 400

_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text: bytes) -> list[bytes]:
    return text.translate(ALNUM).split()


class Automaton:
    """Generalised suffix automaton of items, with the items behind each window.

    Most states go on by one word: that word and where it leads are in ``word``
    and ``to``; ``more`` has the other transitions.
    """

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.ids: dict[bytes, int] = {}
        self.names = sorted({name for name, ws in items if ws and name is not None})
        number = {name: i for i, name in enumerate(self.names)}
        coded = [(number.get(name, -1), array("i", [self.ids.setdefault(w, len(self.ids)) for w in ws])) for name, ws in items if ws]
        self.word, self.to, self.link, self.length = array("i", [-1]), array("i", [-1]), array("i", [-1]), array("i", [0])
        self.more: dict[int, dict[int, int]] = {}
        for _, ws in coded:
            self._add(ws)
        self._mark(coded)

    def _go(self, state: int, c: int) -> int:
        """The next state, or -1."""
        if self.word[state] == c:
            return self.to[state]
        further = self.more.get(state)
        return -1 if further is None else further.get(c, -1)

    def _lead(self, state: int, c: int, to: int) -> None:
        if self.word[state] in (c, -1):
            self.word[state], self.to[state] = c, to
        else:
            self.more.setdefault(state, {})[c] = to

    def _new(self, word: int, to: int, link: int, length: int) -> int:
        for column, x in ((self.word, word), (self.to, to), (self.link, link), (self.length, length)):
            column.append(x)
        return len(self.word) - 1

    def _add(self, ws: array) -> None:
        last = 0
        for c in ws:
            q = self._go(last, c)
            if q >= 0:
                last = q if self.length[q] == self.length[last] + 1 else self._clone(last, c, q)
                continue
            new, p = self._new(-1, -1, 0, self.length[last] + 1), last
            while p >= 0 and (q := self._go(p, c)) < 0:
                self._lead(p, c, new)
                p = self.link[p]
            if p >= 0:
                self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, c, q)
            last = new

    def _clone(self, p: int, c: int, q: int) -> int:
        copy = self._new(self.word[q], self.to[q], self.link[q], self.length[p] + 1)
        if q in self.more:
            self.more[copy] = dict(self.more[q])
        self.link[q] = copy
        while p >= 0 and self._go(p, c) == q:
            self._lead(p, c, copy)
            p = self.link[p]
        return copy

    def _mark(self, coded: list[tuple[int, array]]) -> None:
        """Passages that are whole windows: rows (state, length, item) by state, the longest first.

        ``first`` has a state's first row, ``above`` the nearest suffix that has rows, or -1 each.
        """
        states, lengths, items, pairs, n = array("i"), array("i"), array("i"), set(), len(self.ids)
        for item, ws in coded:
            pairs.update(a * n + b for a, b in zip(ws, ws[1:], strict=False))
            k, state, matched = min(self.window, len(ws)), 0, 0
            for c in ws:
                state, matched = self._go(state, c), min(matched + 1, k)
                # one state holds one passage of a length, but may hold passages of several lengths
                while self.length[self.link[state]] >= matched:
                    state = self.link[state]
                if matched == k:
                    states.append(state)
                    lengths.append(k)
                    items.append(item)
        rows = np.unique(np.array([states, [-k for k in lengths], items], np.int32).reshape(3, -1), axis=1)
        self.row_state, self.row_length, self.row_item = (array("i", x.tolist()) for x in (rows[0], -rows[1], rows[2]))
        self.first, self.above = array("i", [-1]) * len(self.link), array("i", [-1]) * len(self.link)
        for i in range(len(self.row_state) - 1, -1, -1):
            self.first[self.row_state[i]] = i
        for state in np.argsort(np.array(self.length), kind="stable").tolist()[1:]:
            link = self.link[state]
            self.above[state] = link if self.first[link] >= 0 else self.above[link]
        self.shortest = min((min(self.window, len(ws)) for _, ws in coded), default=self.window)
        self.pairs = np.array(sorted(pairs), np.int64)

    def match(self, ws: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Hit spans [start, end) of words, merged, and the items whose windows occur."""
        n = len(ws)
        if n < self.shortest or not self.ids:
            return [], set()
        codes = np.fromiter(map(self.ids.get, ws, repeat(-1)), np.int64, n)
        known = codes >= 0
        if not known.any():
            return [], set()
        # A pair of neighbours that no item has leaves a match of one word at most: restart there.
        both = np.flatnonzero(known[:-1] & known[1:])
        joined = np.zeros(n, bool)  # joined[i]: words i and i + 1 are neighbours in an item
        if len(both) and len(self.pairs):
            keys = codes[both] * len(self.ids) + codes[both + 1]
            at = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
            joined[both] = self.pairs[at] == keys
        edge = np.diff(np.concatenate(([0], joined[:-1].view(np.int8), [0]))) if n > 1 else np.zeros(1, np.int8)
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + 1
        if self.shortest == 1:
            alone = known.copy()
            for a, b in zip(starts, ends, strict=True):
                alone[a:b] = False
            single = np.flatnonzero(alone)
            starts, ends = np.concatenate((starts, single)), np.concatenate((ends, single + 1))
        keep = ends - starts >= self.shortest
        spans: list[tuple[int, int]] = []
        found: set[int] = set()
        for a, b in zip(starts[keep].tolist(), ends[keep].tolist(), strict=True):
            self._run(codes[a:b].tolist(), a, spans, found)
        return merge(spans), {self.names[i] for i in found if i >= 0}

    def _run(self, codes: list[int], at: int, spans: list[tuple[int, int]], found: set[int]) -> None:
        go, link, length = self._go, self.link, self.length
        state = matched = 0
        for i, c in enumerate(codes, at + 1):
            while (to := go(state, c)) < 0 and state:
                state = link[state]
                matched = length[state]
            if to >= 0:
                state = to
                matched += 1
            if longest := self._windows(state, matched, found):
                spans.append((i - longest, i))

    def _windows(self, state: int, matched: int, found: set[int]) -> int:
        """Length of the longest window that ends here, or 0; the items of all are added to ``found``."""
        longest = 0
        if self.first[state] < 0:
            state = self.above[state]
        while state >= 0:
            at = self.first[state]
            while at < len(self.row_state) and self.row_state[at] == state:
                if self.row_length[at] <= matched:
                    longest = max(longest, self.row_length[at])
                    found.add(self.row_item[at])
                at += 1
            state = self.above[state]
        return longest


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
_ARROW_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def window_hashes(ws: list[bytes], lengths: list[int]) -> dict[int, np.ndarray]:
    """For each length, 64-bit hashes of the runs of so many words."""
    codes = np.fromiter(map(zlib.crc32, ws), np.uint64, len(ws))
    out, power, mixed = {}, np.uint64(1), np.zeros(len(ws), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(1, min(max(lengths, default=0), len(ws)) + 1):
            power = power * np.uint64(0x9E3779B97F4A7C15)
            mixed = mixed[: len(ws) - k + 1] + codes[k - 1 :] * power
            if k in lengths:
                out[k] = mixed + np.uint64(k)
    return out


def may_hit(docs: DataFrame, items: DataFrame, window: int) -> DataFrame:
    """The documents that have the hash of a window of the items; one pass for each ``FILTER_WINDOWS`` words of items.

    Of several passes a document comes from each that finds it.
    """
    parts = (items.agg(F.sum(_size())).first()[0] or 0) // FILTER_WINDOWS + 1
    some = [items if parts == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == i) for i in range(parts)]
    return reduce(DataFrame.unionByName, (_may_hit(docs, s, window) for s in some))


def _may_hit(docs: DataFrame, items: DataFrame, window: int) -> DataFrame:
    def of_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in texts(batch, "text"):
                ws = words(text)
                for k, h in window_hashes(ws, [min(window, len(ws))]).items():
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), k, np.int32)), pa.array(h.view(np.int64))], names=["k", "h"])

    found = items.select("text").mapInArrow(of_items, "k int, h long").distinct().toArrow()
    every = found["h"].to_numpy().astype(np.int64).view(np.uint64)
    lengths, of = found["k"].to_numpy(), {}
    for k in np.unique(lengths).tolist():
        of[k] = np.sort(every[lengths == k])
    held = docs.sparkSession.sparkContext.broadcast(of)

    def has_any(ws: list[bytes]) -> bool:
        for k, h in window_hashes(ws, list(held.value)).items():
            known = held.value[k]
            if (known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h).any():
                return True
        return False

    def of_docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_worker("decontaminate")
        for batch in batches:
            yield batch.filter(pa.array([has_any(words(text)) for text in texts(batch, "text")], pa.bool_()))

    return docs.mapInArrow(of_docs, docs.schema)


def _size() -> F.Column:
    """Words of a text, and one or two more."""
    return F.size(F.split("text", r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"))


def _items(benchmark: DataFrame, unnamed: bool) -> DataFrame:
    return benchmark.where("text is not null" if unnamed else "item_id is not null and text is not null").select(F.col("item_id").cast("string").alias("item_id"), "text").distinct()


def automata(benchmark: DataFrame, window: int, limit: int | None = None, unnamed: bool = False) -> Iterator[tuple[Automaton, bool]]:
    """One automaton for each ``limit`` words of items (those with null ids only where ``unnamed``), and whether it is the only one.

    Items are read block by block, so the driver holds one automaton at a time.
    """
    items = _items(benchmark, unnamed)
    blocks = (items.agg(F.sum(_size())).first()[0] or 0) // (limit or AUTOMATON_WORDS) + 1
    for block in range(blocks):
        some = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        rows = sorted(((r.item_id, r.text) for r in some.collect()), key=lambda r: (r[0] is None, r[0] or "", r[1]))
        yield Automaton([(name, words(text.encode())) for name, text in rows], window), blocks == 1


def annotate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, limit: int | None = None, unnamed: bool = False) -> DataFrame:
    """Adds n_words, hit_spans (word positions, merged) and hit_items to each document.

    One narrow pass without a shuffle where the items fit one automaton; else a
    pass for each block of items over the texts that have a window of any, whose
    hits alone are joined back.
    """
    docs = docs.drop("n_words", "hit_spans", "hit_items")
    store, held, hits = None, None, []
    for automaton, alone in automata(benchmark, window, limit, unnamed):
        if alone:
            return _pass(docs, docs.sparkSession.sparkContext.broadcast(automaton))
        if store is None:
            store = Store(docs.sparkSession, "decontaminate")
            file, row, of_file, of_row = fresh(docs, "file", "row", "of_file", "of_row")
            held = store.keep(docs, "docs").withColumns({file: F.col("_metadata.file_name"), row: F.col("_metadata.row_index")})
            bound_batches(docs.sparkSession)
            likely = store.keep(may_hit(held.select(F.col(file).alias(of_file), F.col(row).alias(of_row), "text"), _items(benchmark, unnamed), window), "likely")
        sent = docs.sparkSession.sparkContext.broadcast(automaton)
        found = _pass(likely, sent).where(F.size("hit_spans") > 0)
        hits.append(store.keep(found.select(of_file, of_row, "hit_spans", "hit_items"), f"hits{len(hits)}"))
        sent.destroy()
        del automaton
    every = hits[0]
    for some in hits[1:]:
        every = every.unionByName(some)
    together = every.groupBy(of_file, of_row).agg(
        _merged(F.sort_array(F.flatten(F.collect_list("hit_spans")))).alias("hit_spans"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("hit_items")))).alias("hit_items"),
    )
    n_words = F.coalesce(F.regexp_count("text", F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")), F.lit(0)).cast("long")
    return held.join(together, (F.col(file) == F.col(of_file)) & (F.col(row) == F.col(of_row)), "left").select(
        *docs.columns,
        n_words.alias("n_words"),
        F.coalesce("hit_spans", F.array().cast(SPANS)).alias("hit_spans"),
        F.coalesce("hit_items", F.array().cast("array<string>")).alias("hit_items"),
    )


def _merged(spans: F.Column) -> F.Column:
    """Sorted spans, those that meet or overlap put together."""
    last = lambda done: F.element_at(done, -1)

    def step(done: F.Column, s: F.Column) -> F.Column:
        grown = F.struct(last(done)["start"].alias("start"), F.greatest(last(done)["end"], s["end"]).alias("end"))
        return F.when((F.size(done) > 0) & (s["start"] <= last(done)["end"]), F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(grown))).otherwise(F.concat(done, F.array(s)))

    return F.aggregate(spans, F.array().cast(SPANS), step)


def _pass(docs: DataFrame, held) -> DataFrame:
    """One pass with a broadcast automaton."""
    bound_batches(docs.sparkSession)
    schema = with_fields(
        docs,
        T.StructField("n_words", T.LongType()),
        T.StructField("hit_spans", SPANS),
        T.StructField("hit_items", T.ArrayType(T.StringType())),
    )
    names = [f.name for f in schema.fields[:-3]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_worker("decontaminate")
        for batch in batches:
            counts, spans, items = _hits(batch, held.value)
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(n) for n in names),
                    pa.array(counts, pa.int64()),
                    pa.array([[{"start": a, "end": b} for a, b in hit] for hit in spans], _ARROW_SPANS),
                    pa.array(items, pa.list_(pa.string())),
                ],
                names=[f.name for f in schema.fields],
            )

    return docs.mapInArrow(run, schema)


def _hits(batch: pa.RecordBatch, auto: Automaton) -> tuple[list[int], list[list[tuple[int, int]]], list[list[str]]]:
    """Words, hit spans and items of each text."""
    counts, spans, items = [], [], []
    for text in texts(batch, "text"):
        ws = words(text)
        hit, found = auto.match(ws)
        counts.append(len(ws))
        spans.append(hit)
        items.append(sorted(found))
    return counts, spans, items


def n_hit() -> F.Column:
    """Words inside the spans."""
    return F.aggregate("hit_spans", F.lit(0).cast("long"), lambda t, s: t + (s["end"] - s["start"]))


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the bytes from the first to the last word of each span."""
    raw = text.encode()
    places = [m.span() for m in _WORD.finditer(raw.lower())]
    keep, at = [], 0
    for a, b in spans:
        keep.append(raw[at : places[a][0]])
        at = places[b - 1][1]
    return b"".join([*keep, raw[at:]]).decode()


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_span: int = WINDOW - 1, max_coverage: float = 0.5, unnamed: bool = False) -> DataFrame:
    """Removes what the benchmark has from the texts; the columns stay as they were.

    A span of more than ``max_span`` words is cut out of its text (spans of
    whole shorter items are cut too where ``max_span`` is below their length); a
    document with more than ``max_coverage`` of its words in spans goes.
    Documents without hits stay untouched. Words that a cut brings together are
    looked at again, until no span of more than ``max_span`` words is left.
    """
    bound_batches(docs.sparkSession)
    automaton, alone = next(iter(automata(benchmark, window, unnamed=unnamed)))
    if not alone:
        return _by_blocks(docs, benchmark, window, max_span, max_coverage, unnamed)
    held, schema = docs.sparkSession.sparkContext.broadcast(automaton), docs.schema

    def clean(text: str, hit: list[tuple[int, int]]) -> str:
        while long := [(a, b) for a, b in hit if b - a > max_span]:
            text = cut(text, long)
            hit = held.value.match(words(text.encode()))[0]
        return text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The pass that finds also removes, so that a text goes to Python once."""
        take_worker("decontaminate")
        for batch in batches:
            counts, spans, _ = _hits(batch, held.value)
            keep = [sum(b - a for a, b in hit) <= n * max_coverage for n, hit in zip(counts, spans, strict=True)]
            new = [clean(text, hit) if kept and hit else text for text, hit, kept in zip(batch.column("text").to_pylist(), spans, keep, strict=True)]
            columns = [pa.array(new, batch.column("text").type) if f.name == "text" else batch.column(f.name) for f in schema.fields]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names).filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, schema)


def _by_blocks(docs: DataFrame, benchmark: DataFrame, window: int, max_span: int, max_coverage: float, unnamed: bool) -> DataFrame:
    """The same for benchmarks of several automata: rounds of passes and cuts, over the texts that were cut last."""
    store, columns, done, step = Store(docs.sparkSession, "decontaminate-blocks"), docs.columns, None, 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = [[(s["start"], s["end"]) for s in hit if s["end"] - s["start"] > max_span] for hit in batch.column("hit_spans").to_pylist()]
            new = [cut(text, hit) for text, hit in zip(batch.column("text").to_pylist(), hits, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(new, batch.column("text").type) if c == "text" else batch.column(c) for c in columns], names=columns)

    todo = docs
    while True:
        found = annotate(todo, benchmark, window, unnamed=unnamed)
        if not step:
            found = found.where(n_hit() <= F.col("n_words") * max_coverage)
        found = store.keep(found, f"found{step}")
        long = F.exists("hit_spans", lambda s: s["end"] - s["start"] > max_span)
        clean = found.where(~long).select(*columns)
        done = clean if done is None else done.unionByName(clean)
        todo = store.keep(found.where(long).mapInArrow(run, docs.schema), f"cut{step}")
        if not todo.limit(1).count():
            return done
        step += 1
