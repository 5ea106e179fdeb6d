"""N-gram Jaccard join by a token-group matrix, to whole components of linked documents.

A document is its set of word shingles, each a 64-bit hash. Documents of equal
sets, by 128 bits, are one class from the start. Classes go by the first 64 of
these bits; a class whose name another one has too gets a new name, and the few
such names go along with the passes over texts. Two classes link when
``100 * intersection >= 80 * union``.

Candidates. Shingles have an order: those known to be frequent last, else by
hash. Linked sets share a shingle among the first ``n - ceil(0.8 n) + 1`` of
each, so classes meet in the posting lists of these. A pair needs, from the
shared shingle on, enough shingles left in both sets; that also bounds the sizes.
Any order gives all pairs; the frequent ones come last only to keep lists short.

Groups. Each candidate goes to the group of one leader of its lists. A task
takes a bounded part of a group and keeps the matrix of groups and tokens: for
each group found so far the union of its members' tokens. One look at the matrix
bounds a document's overlap with all groups; only groups that could hold a link
are opened, and those that do merge. What is left are candidates in different
components: these are held against whole groups in the same way, a union first,
members only if it qualifies. A few documents of each component ask first, which
merges most of a large group of copies; then all that are left do.

Lists of up to ``SMALL_LIST`` classes give their pairs; longer ones give a pair
with their leader each, and later only pairs over different components. A list
has rows of up to ``LIST_ROW`` classes, and the classes of very long ones are dealt to
all tasks; where lists are asked later, a list is a grid of cells of about
``CELL`` questions by ``CELL`` groups, so that no task holds a whole one.

Defined results: a null text, or one without words, has an empty set and is its
own component; fewer words than the shingle length make one shingle; a null
doc_id never names a component, unless all of its ids are null; repeated rows
each appear. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import Store, give_back, take_worker, tasks, texts
from tabloom.llm.components import components

SHINGLE = 5
#: Similarity as a ratio of whole numbers.
NUM, DEN = 80, 100
#: Shingles looked through together for repeats, at least two sets of which make a shingle count as repeated.
CHUNK = 4_000_000
#: Shingles that so many repeats were counted of are ordered last.
FREQUENT = 2
#: Cells of a class's sketch: how many of its shingles fall in each, 255 for that many or more.
CELLS = 256
SMALL_LIST = 8
#: Classes in a row of a list, and in a task's share of a list that is dealt to all tasks from the start.
LIST_ROW, HOT_PIECE = 1000, 64
#: Entries of prefixes that one task sorts.
PART_ENTRIES = 4_000_000
#: Questions and groups in a cell of a list, and shares of a list of several rows where it meets a row of its own.
CELL, LIST_SALTS = 500, 64
#: Bits of a class's first name; tests take fewer, so that names clash.
NAME_BITS = 64
#: A task's part of a leader's group: documents and tokens.
PART_DOCS, PART_TOKENS = 256, 300_000
#: Documents in a group that queries are held against, and queries in a salt of it.
GROUP, SALT = 64, 1000
#: Rounds in which a few documents of each component ask some groups of the largest one in their list, and how many; then all ask.
WITNESS_ROUNDS, WITNESSES, ASKED = 2, 2, 4
#: Bits of a broadcast filter. Wrong hits only cost: a set that nothing asks for, a shingle ordered last.
FILTER_BITS = 1 << 26

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_POWERS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


class _Words(dict):
    """Words to places in an array of their hashes."""

    def __init__(self):
        super().__init__()
        self.hashes = np.zeros(1024, np.uint64)

    def __missing__(self, word: bytes) -> int:
        at = len(self)
        if at == len(self.hashes):
            self.hashes = np.concatenate((self.hashes, np.zeros_like(self.hashes)))
        self.hashes[at] = xxhash.xxh3_64_intdigest(word)
        self[word] = at
        return at


_words = _Words()


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes, k: int = SHINGLE) -> np.ndarray:
    """The distinct shingles' hashes, ascending."""
    ws = text.lower().split()
    if not ws:
        return np.zeros(0, np.uint64)
    take_worker("jaccard", _words.clear)
    if len(_words) > 300_000:
        _words.clear()
    at = np.fromiter(map(_words.__getitem__, ws), np.int64, len(ws))
    h = _words.hashes[at]
    n = max(len(h) - k + 1, 1)
    out = np.full(n, min(len(h), k), np.uint64)
    for j in range(min(k, len(h))):
        out += h[j : j + n] * _POWERS[j]
    out = mix(out)
    out.sort()
    return out[np.concatenate(([True], out[1:] != out[:-1]))]


def _name(s: np.ndarray, salt: int, power: np.uint64) -> int:
    total = mix(s ^ np.uint64(salt)).sum(dtype=np.uint64, keepdims=True)
    return int(mix(total ^ (np.array([len(s)], np.uint64) * power)).view(np.int64)[0])


def identity(s: np.ndarray, bits: int = 64) -> int:
    """A set's signed 64-bit name, or so many low bits of it."""
    name = _name(s, 0x5851F42D4C957F2D, _POWERS[0])
    return name if bits == 64 else name & ((1 << bits) - 1)


def second(s: np.ndarray) -> int:
    """64 bits more of a set's identity."""
    return _name(s, 0x2545F4914F6CDD1D, _POWERS[1])


def known_as(s: np.ndarray, bits: int, renamed: dict[int, dict[int, int]]) -> int:
    """The name of a set's class; ``renamed`` has new names by clashing first name and second one."""
    name = identity(s, bits)
    return renamed[name].get(second(s), name) if name in renamed else name


def sketch(s: np.ndarray) -> bytes:
    """Counts of shingles by cell. The sum of the lesser counts of two sketches bounds the overlap."""
    return np.minimum(np.bincount((s & np.uint64(CELLS - 1)).view(np.int64), minlength=CELLS), 255).astype(np.uint8).tobytes()


def overlap_bound(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For rows of sketches; a cell that is full in both bounds nothing."""
    low = np.minimum(a, b)
    return np.where((low == 255).any(-1), 1 << 60, low.sum(-1, dtype=np.int64))


def links(both: int, a: int, b: int) -> bool:
    return DEN * both >= NUM * (a + b - both)


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    return int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())


def least_overlap(a, b):
    """Smallest intersection that links sets of these sizes: 100 i >= 80 (a + b - i)."""
    return -(-(NUM * (a + b)) // (NUM + DEN))


def prefix(n: int) -> int:
    return n - -(-NUM * n // DEN) + 1


def feasible(n1, i1, n2, i2):
    """Whether sets that first share a shingle at these places (from 0) can link."""
    return np.minimum(n1 - i1, n2 - i2) >= least_overlap(n1, n2)


def _forget() -> None:
    _words.clear()
    give_back()


def lets_go(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A pass over texts that ends with its words dropped: workers that wait beside later steps, which need the JVM's memory, hold little."""

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            _forget()

    return passed


# pass one: every document's size and class, and repeated shingles


def describe(docs: DataFrame) -> DataFrame:
    """kind 0: (doc_id, size, both parts of its set's identity, sketch) of a document; kind 1: (null, times, shingle, 0, null) of a repeated shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size, seen = 0, set()

        def repeats() -> pa.RecordBatch:
            nonlocal size
            every = np.concatenate(held)
            held.clear()
            seen.clear()
            size = 0
            every.sort()
            # places are kept of repeated ones only: from each one's second on, which runs to its last
            again = np.concatenate(([False], every[1:] == every[:-1], [False]))
            edges = np.flatnonzero(again[1:] != again[:-1])
            first, last = edges[::2], edges[1::2]
            return _rows(1, None, last - first + 1, every[first].view(np.int64), np.zeros(len(first), np.int64))

        for batch in batches:
            sizes, names, seconds, sketches = [], [], [], []
            for text in texts(batch, "text"):
                s = shingles(text)
                name = identity(s, NAME_BITS), second(s)
                sizes.append(len(s))
                names.append(name[0])
                seconds.append(name[1])
                sketches.append(None if name in seen or not len(s) else sketch(s))
                if name not in seen:
                    seen.add(name)
                    held.append(s)
                    size += len(s)
                    if size > CHUNK:
                        yield repeats()
            yield _rows(0, batch.column("doc_id"), np.array(sizes, np.int64), np.array(names, np.int64), np.array(seconds, np.int64), sketches)
        if held:
            yield repeats()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lets_go(run), "kind int, doc_id long, n long, h long, h2 long, sketch binary")


def _rows(kind: int, ids, n: np.ndarray, h: np.ndarray, h2: np.ndarray, sketches: list | None = None) -> pa.RecordBatch:
    ids = pa.nulls(len(n), pa.int64()) if ids is None else ids
    sketches = pa.nulls(len(n), pa.binary()) if sketches is None else pa.array(sketches, pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(n), kind, np.int32)), ids, pa.array(n.astype(np.int64)), pa.array(h), pa.array(h2), sketches], names=["kind", "doc_id", "n", "h", "h2", "sketch"])


def name_classes(described: DataFrame, store: Store) -> tuple[DataFrame, DataFrame, dict[int, dict[int, int]]]:
    """doc_id, n and name of each row; name, n and sketch of each class; and the new names.

    Of sets with one first name the least second one keeps it. The driver gets the
    others: of x sets some x * x / 2 ** 65, three of 10 ** 10.
    """
    first = described.where("kind = 0 and sketch is not null")
    found = store.keep(first.groupBy("h").agg(F.min("h2").alias("low"), F.max("h2").alias("high"), F.min_by(F.struct("n", "sketch"), "h2").alias("of")), "found")
    classes = found.select(F.col("h").alias("name"), "of.n", "of.sketch")
    rows = described.where("kind = 0")
    clash = first.join(found.where("low != high").select("h", "low"), "h").where("h2 != low")
    renamed: dict[int, dict[int, int]] = {}
    for r in clash.select("h", "h2").distinct().collect() if found.where("low != high").limit(1).count() else []:
        digest = xxhash.xxh3_64_digest(np.array([r.h, r.h2], np.int64).tobytes())
        renamed.setdefault(r.h, {})[r.h2] = int(np.frombuffer(digest, np.int64)[0])
    if not renamed:
        return rows.select("doc_id", "n", F.col("h").alias("name")), classes, renamed
    new = store.spark.createDataFrame([(h, h2, x) for h, own in renamed.items() for h2, x in own.items()], "h long, h2 long, new long")
    classes = classes.unionByName(clash.join(F.broadcast(new), ["h", "h2"]).select(F.col("new").alias("name"), "n", "sketch").dropDuplicates(["name"]))
    return rows.join(F.broadcast(new), ["h", "h2"], "left").select("doc_id", "n", F.coalesce("new", "h").alias("name")), classes, renamed


# pass two: prefixes, and posting lists of them

_ENTRY = np.dtype([("shingle", "<u8"), ("name", "<i8"), ("n", "<i4"), ("at", "<i4")])


def filters(df: DataFrame, column: str, *which: Column) -> list[np.ndarray]:
    """A bit for each value of a long column in rows of each kind, in ``FILTER_BITS`` bits: a bound on what the driver and the broadcast hold."""
    word = F.shiftrightunsigned(F.col(column), 6).bitwiseAND(F.lit(FILTER_BITS // 64 - 1))
    bit = F.expr(f"shiftleft(1L, cast({column} & 63 as int))")
    found = df.groupBy(word.alias("word")).agg(*(F.bit_or(F.when(w, bit).otherwise(0)).alias(f"bits{i}") for i, w in enumerate(which))).toArrow()
    out = []
    for i in range(len(which)):
        bits = np.zeros(FILTER_BITS // 64, np.uint64)
        bits[found["word"].to_numpy()] = found[f"bits{i}"].to_numpy().view(np.uint64)
        out.append(bits)
    return out


def maybe_in(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    word = bits[((values >> np.uint64(6)) & np.uint64(len(bits) - 1)).view(np.int64)]
    return (word >> (values & np.uint64(63))) & np.uint64(1) > 0


def postings(docs: DataFrame, frequent: np.ndarray, hot: np.ndarray, renamed: dict[int, dict[int, int]], parts: int) -> DataFrame:
    """list, and names, sizes and places of classes in it, up to ``LIST_ROW`` in a row; whole where the list has no other row.

    Whole lists have two classes or more. Entries travel packed, a run for each
    part, so that rows cost nothing; those of a hot shingle go to all parts.
    """
    held = docs.sparkSession.sparkContext.broadcast((frequent, hot))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late, hot = held.value
        waiting: list[np.ndarray] = []
        size, seen = 0, set()

        def flush() -> pa.RecordBatch:
            every = np.concatenate(waiting)
            waiting.clear()
            share = np.where(maybe_in(hot, every["shingle"]), mix(np.ascontiguousarray(every["name"]).view(np.uint64)), np.uint64(0))
            part = ((every["shingle"] + share) % np.uint64(parts)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            every, part = every[order], part[order]
            first = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
            ends = np.append(first[1:], len(part))
            return pa.RecordBatch.from_arrays([pa.array(part[first]), pa.array([every[a:b].tobytes() for a, b in zip(first, ends, strict=True)], pa.binary())], names=["part", "entries"])

        for batch in batches:
            for text in texts(batch, "text"):
                s = shingles(text)
                name = known_as(s, NAME_BITS, renamed)
                if not len(s) or name in seen:
                    continue
                if len(seen) > 1_000_000:
                    seen.clear()
                seen.add(name)
                n, p = len(s), prefix(len(s))
                last = maybe_in(late, s)
                if last.any():
                    s = np.concatenate((s[~last], s[last]))
                own = np.empty(p, _ENTRY)
                own["shingle"], own["name"], own["n"], own["at"] = s[:p], name, n, np.arange(p)
                waiting.append(own)
                size += p
                if size > 1_000_000:
                    yield flush()
                    size = 0
        if waiting:
            yield flush()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = [x for b in batches for x in b.column("entries").to_pylist()]
        if not runs:
            return
        every = np.frombuffer(b"".join(runs), _ENTRY)
        del runs
        order = np.lexsort((every["name"], every["shingle"]))
        every = every[order]
        again = (every["shingle"][1:] == every["shingle"][:-1]) & (every["name"][1:] == every["name"][:-1])
        every = every[np.concatenate(([True], ~again))]
        shingle = every["shingle"]
        first = np.flatnonzero(np.concatenate(([True], shingle[1:] != shingle[:-1])))
        length = np.diff(np.append(first, len(shingle)))
        spread = maybe_in(held.value[1], shingle[first])
        keep = (length > 1) | spread
        every = every[np.repeat(keep, length)]
        length, spread = length[keep], spread[keep]
        pieces = -(-length // LIST_ROW)
        of = np.repeat(np.arange(len(length)), pieces)
        piece = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        offsets = np.append((np.cumsum(length) - length)[of] + piece * LIST_ROW, len(every))
        whole = (~spread & (pieces == 1))[of]
        a = 0
        while a < len(of):
            b = min(a + 10_000, max(a + 1, int(np.searchsorted(offsets, offsets[a] + 1_000_000))), len(of))
            some, off = every[offsets[a] : offsets[b]], pa.array((offsets[a : b + 1] - offsets[a]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [pa.array(every["shingle"][offsets[a:b]].view(np.int64)), pa.array(whole[a:b])]
                + [pa.ListArray.from_arrays(off, pa.array(np.ascontiguousarray(some[c]).astype(np.int64))) for c in ("name", "n", "at")],
                names=["list", "whole", "names", "sizes", "places"],
            )
            a = b

    packed = docs.select("text").mapInArrow(lets_go(send), "part int, entries binary").repartitionById(parts, "part")
    return packed.mapInArrow(gather, "list long, whole boolean, names array<long>, sizes array<long>, places array<long>")


def first_pairs(lists: DataFrame) -> DataFrame:
    """Feasible pairs (a, b): all of short lists, those with the leader of a longer one's row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            lists = batch.column("names")
            off = lists.offsets.to_numpy()
            off = off - off[0]
            name, n, at = (batch.column(c).flatten().to_numpy() for c in ("names", "sizes", "places"))
            length = np.diff(off)
            short = (length <= SMALL_LIST) & batch.column("whole").to_numpy(zero_copy_only=False)
            for m in np.unique(length[short]):
                block = off[:-1][short & (length == m)][:, None] + np.arange(m)
                for i in range(m):
                    for j in range(i + 1, m):
                        found.append((block[:, i], block[:, j]))
            for r in np.flatnonzero(~short):
                own = np.arange(off[r], off[r + 1])
                index = own[feasible(n[own], at[own], n[own], at[own])]
                if len(index):
                    lead = index[np.argmin(name[index])]
                    found.append((own[own != lead], np.full(len(own) - 1, lead)))
            if not found:
                continue
            x, y = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
            ok = feasible(n[x], at[x], n[y], at[y])
            x, y = name[x[ok]], name[y[ok]]
            both = np.unique(np.stack((np.minimum(x, y), np.maximum(x, y)), 1), axis=0) if len(x) else np.zeros((0, 2), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(both[:, 0])), pa.array(np.ascontiguousarray(both[:, 1]))], names=["a", "b"])

    return lists.mapInArrow(run, "a long, b long").distinct()


def _sketches(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, CELLS)


def bounded(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs whose sketches leave room for a link."""
    a, b = (classes.select(F.col("name").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}")) for x in "ab")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                n = least_overlap(batch.column("na").to_numpy(), batch.column("nb").to_numpy())
                keep = overlap_bound(_sketches(batch.column("sa")), _sketches(batch.column("sb"))) >= n
                yield batch.select(["a", "b"]).filter(pa.array(keep))

    return pairs.join(a, "a").join(b, "b").mapInArrow(run, "a long, b long")


def entries(lists: DataFrame) -> DataFrame:
    """list, whole, name, n, at of the longer lists."""
    longer = lists.where((F.size("names") > SMALL_LIST) | ~F.col("whole"))
    each = longer.select("list", "whole", F.explode(F.arrays_zip("names", "sizes", "places")).alias("e"))
    return each.select("list", "whole", F.col("e.names").alias("name"), F.col("e.sizes").alias("n"), F.col("e.places").alias("at"))


def _by_list(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...], convert=lambda t, c: t.column(c).to_numpy()) -> Iterator[dict[str, np.ndarray]]:
    """The rows of each list, of rows sorted by list; a few lists at a time are in memory."""
    rest: list[pa.RecordBatch] = []

    def lists(table: pa.Table) -> Iterator[dict[str, np.ndarray]]:
        whole = {c: convert(table, c) for c in columns}
        key = table.column("list").to_numpy()
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        for a, b in zip(first, np.append(first[1:], len(key)), strict=True):
            yield {c: v[a:b] for c, v in whole.items()}

    for batch in batches:
        if not batch.num_rows:
            continue
        rest.append(batch)
        if batch.column("list")[-1] != rest[0].column("list")[0]:
            table = pa.Table.from_batches(rest)
            key = table.column("list").to_numpy()
            cut = int(np.flatnonzero(key[1:] != key[:-1])[-1]) + 1
            yield from lists(table.slice(0, cut))
            rest = table.slice(cut).to_batches()
    if rest:
        yield from lists(pa.Table.from_batches(rest))


def in_long_lists(lists: DataFrame, classes: DataFrame) -> DataFrame:
    """Names in longer lists that places and sketches let link to another of the list, and all of lists of several rows."""
    every = entries(lists)
    ready = every.where("whole").drop("whole").join(classes.select("name", "sketch"), "name").repartition(tasks(lists.sparkSession), "list").sortWithinPartitions("list")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in _by_list(batches, ("name", "n", "at", "sketch"), lambda t, c: _sketches(t.column(c)) if c == "sketch" else t.column(c).to_numpy()):
            # by size: partners of a set are among those up to a quarter larger
            order = np.argsort(own["n"], kind="stable")
            name, n, at, cells = (own[c][order] for c in ("name", "n", "at", "sketch"))
            could = np.zeros(len(n), bool)
            most = np.searchsorted(n, DEN * n // NUM, "right")
            for i in np.flatnonzero(feasible(n, at, n, at)):
                to = i + 1 + np.flatnonzero(feasible(n[i], at[i], n[i + 1 : most[i]], at[i + 1 : most[i]]))
                if could[i]:
                    to = to[~could[to]]
                for a in range(0, len(to), 4096):
                    some = to[a : a + 4096]
                    hit = some[overlap_bound(cells[some], cells[i]) >= least_overlap(n[i], n[some])]
                    if len(hit):
                        could[i] = True
                        could[hit] = True
            yield pa.RecordBatch.from_arrays([pa.array(name[could])], names=["name"])

    return ready.mapInArrow(run, "name long").unionByName(every.where("not whole").select("name")).distinct()


# pass three: the sets of candidates


def candidate_sets(docs: DataFrame, names: DataFrame, renamed: dict[int, dict[int, int]]) -> DataFrame:
    """name and tokens (ascending unsigned 64-bit) of the named classes, one row each."""
    (bits,) = filters(names, "name", F.lit(True))
    held = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = held.value
        seen = set()
        for batch in batches:
            names, sets = [], []
            for text in texts(batch, "text"):
                s = shingles(text)
                name = known_as(s, NAME_BITS, renamed)
                if not len(s) or name in seen or not maybe_in(bits, np.array([name], np.int64).view(np.uint64))[0]:
                    continue
                if len(seen) > 1_000_000:
                    seen.clear()
                seen.add(name)
                names.append(name)
                sets.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(sets, pa.binary())], names=["name", "tokens"])

    return docs.select("text").mapInArrow(lets_go(run), "name long, tokens binary").dropDuplicates(["name"])


# groups


class Groups:
    """Token-group matrix over one part: groups grow by documents that link to a member."""

    def __init__(self, names: list[int], sets: list[np.ndarray]):
        self.names, self.sets = names, sets
        every = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        tokens, local = np.unique(every, return_inverse=True)
        ends = np.cumsum([len(s) for s in sets])
        self.local = [local[e - len(s) : e] for e, s in zip(ends, sets, strict=True)]
        self.matrix = np.zeros((8, len(tokens)), bool)
        self.members: list[list[int]] = []

    def join(self) -> list[tuple[int, int]]:
        """Edges (name, name of another member) that connect all linked documents of the part."""
        edges = []
        for q in sorted(range(len(self.sets)), key=lambda i: (len(self.sets[i]), self.names[i])):
            mine, size = self.local[q], len(self.sets[q])
            bound = self.matrix[: len(self.members), mine].sum(1)
            hit = []
            for g in np.flatnonzero(DEN * bound >= NUM * size):
                for m in self.members[g]:
                    most = len(self.sets[m])
                    if min(bound[g], most) >= least_overlap(size, most) and links(overlap(self.sets[q], self.sets[m]), size, most):
                        hit.append(int(g))
                        edges.append((self.names[q], self.names[m]))
                        break
            self._put(q, hit)
        return edges

    def _put(self, q: int, hit: list[int]) -> None:
        if not hit:
            hit = [len(self.members)]
            self.members.append([])
            if len(self.members) > len(self.matrix):
                self.matrix = np.concatenate((self.matrix, np.zeros_like(self.matrix)))
        to, *rest = hit
        self.members[to].append(q)
        self.matrix[to, self.local[q]] = True
        for g in reversed(rest):
            self.members[to] += self.members[g]
            self.matrix[to] |= self.matrix[g]
            last = len(self.members) - 1
            self.members[g] = self.members[last]
            self.matrix[g] = self.matrix[last]
            self.matrix[last] = False
            self.members.pop()


def in_groups(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Edges (u, v) found within the groups of leaders; each set travels to one group (a leader's also to its own)."""
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    home = both.groupBy("a").agg(F.least("a", F.min("b")).alias("home")).select(F.col("a").alias("name"), "home", F.lit(1).alias("kind"))
    home = home.unionByName(home.select(F.col("home").alias("name"), "home", F.lit(0).alias("kind")).distinct()).where("kind = 0 or name != home")
    rows = home.join(sets, "name").select("home", "kind", "name", "tokens")
    # a group of any size is dealt to tasks in salts, each with the leader; the task cuts it into parts
    sizes = home.groupBy("home").agg(F.ceil(F.count("*") / (4 * PART_DOCS)).cast("int").alias("salts"))
    salt = F.when(F.col("kind") == 0, F.sequence(F.lit(0), F.col("salts") - 1)).otherwise(F.array(F.pmod(F.xxhash64("name"), F.col("salts")).cast("int")))
    dealt = rows.join(sizes, "home").withColumn("salt", F.explode(salt)).select("home", "salt", "kind", "name", "tokens")
    ready = dealt.repartition(tasks(pairs.sparkSession), "home", "salt").sortWithinPartitions("home", "salt", "kind", "name")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, names, sets, size = None, [], [], 0

        def close() -> pa.RecordBatch:
            edges = Groups(names, sets).join() if len(names) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([e[0] for e in edges], pa.int64()), pa.array([e[1] for e in edges], pa.int64())], names=["u", "v"])

        for batch in batches:
            for row in batch.to_pylist():
                s = np.frombuffer(row["tokens"], np.uint64)
                if (row["home"], row["salt"]) != group or len(names) >= PART_DOCS or size + len(s) > PART_TOKENS:
                    yield close()
                    same = (row["home"], row["salt"]) == group
                    names, sets = (names[:1], sets[:1]) if same else ([], [])  # the leader stays
                    group, size = (row["home"], row["salt"]), sum(map(len, sets))
                names.append(row["name"])
                sets.append(s)
                size += len(s)
        yield close()

    return ready.mapInArrow(run, "u long, v long")


def grouped(names: DataFrame, roots: DataFrame, store: Store, name: str) -> DataFrame:
    """name, root, size (of the component) and gid, the group of at most about ``GROUP`` classes of it.

    Sizes are stored before they meet the classes: a join with a table, other than one with a grouping by the
    same key in its stage, lets Spark split the rows of a large component over tasks.
    """
    known = names.join(roots.withColumnRenamed("node", "name"), "name", "left").select("name", F.coalesce("root", "name").alias("root"))
    sizes = store.keep(known.groupBy("root").agg(F.count("*").alias("size")).where("size > 1"), f"{name}-sizes")
    known = known.join(sizes, "root", "left").withColumn("size", F.coalesce("size", F.lit(1)))
    parts = F.ceil(F.col("size") / GROUP).cast("int")
    gid = F.xxhash64("root", F.pmod(F.xxhash64("name"), parts))
    return store.keep(known.select("name", "root", "size", F.when(parts == 1, F.col("root")).otherwise(gid).alias("gid")), name)


def open_pairs(pairs: DataFrame | None, mixed: DataFrame, of: DataFrame, few: int | None = None, seed: int = 0) -> DataFrame:
    """Queries (name, gid): feasible candidates of different components, where the smaller one asks.

    With ``few``, so many documents of each component ask ``ASKED`` groups of the largest one in the list.
    """
    out = None
    if pairs is not None:
        a, b = (of.select(*(F.col(c).alias(f"{c}_{x}") for c in of.columns)) for x in "ab")
        met = pairs.join(a, F.col("a") == F.col("name_a")).join(b, F.col("b") == F.col("name_b")).where("root_a != root_b")
        a_asks = F.struct("size_a", "root_a") < F.struct("size_b", "root_b")
        out = met.select(F.when(a_asks, F.col("a")).otherwise(F.col("b")).alias("name"), F.when(a_asks, F.col("gid_b")).otherwise(F.col("gid_a")).alias("gid"))
    long_ = witnesses(mixed, few, seed) if few is not None else _asked(mixed, tasks(of.sparkSession))
    return (long_ if out is None else out.unionByName(long_)).distinct()


def _salts(many: Column) -> Column:
    return F.explode(F.when(many, F.sequence(F.lit(0), F.lit(LIST_SALTS - 1))).otherwise(F.array(F.lit(0))))


def _salt(many: Column) -> Column:
    return F.when(many, F.pmod(F.xxhash64("name"), F.lit(LIST_SALTS)).cast("int")).otherwise(0)


def _mixed(lists: DataFrame, of: DataFrame) -> DataFrame:
    """The entries of longer lists over several components: whose is one of the list's largest component, and the list's counts."""
    every = entries(lists).join(of, "name")
    by_root = every.groupBy("list", "whole", "root", "size").agg(F.count("*").alias("m"))
    mixed = by_root.groupBy("list", "whole").agg(F.sum("m").alias("m"), F.max(F.struct("size", "root", "m")).alias("best"), F.count("*").alias("roots")).where("roots > 1")
    mixed = mixed.select("list", F.col("best.root").alias("best"), "m", (F.col("m") - F.col("best.m")).alias("asking"), _salts(~F.col("whole")).alias("salt"))
    return every.withColumn("salt", _salt(~F.col("whole"))).join(mixed, ["list", "salt"])


def witnesses(mixed: DataFrame, few: int, seed: int) -> DataFrame:
    """(name, gid): up to ``few`` documents of each other component of a list, and up to ``ASKED`` groups of its largest one.

    Each comes as the least hash of its turn, so that nothing of a list is gathered.
    """
    name_turn, gid_turn = F.xxhash64("name", F.lit(seed)), F.xxhash64("gid", F.lit(seed))
    groups = mixed.where("root = best").groupBy("list", "whole", F.pmod(gid_turn, F.lit(ASKED)).alias("turn"))
    groups = groups.agg(F.min_by("gid", gid_turn).alias("gid"), F.min("n").alias("least"), F.max("n").alias("most"), F.max(F.col("n") - F.col("at")).alias("left"))
    asks = mixed.where("root != best").groupBy("list", "whole", "root", F.pmod(name_turn, F.lit(few)).alias("turn"))
    asks = asks.agg(F.min_by(F.struct("name", "n", "at"), name_turn).alias("of")).select("list", "whole", "of.*")
    met = asks.withColumn("salt", _salt(~F.col("whole"))).join(groups.select("*", _salts(~F.col("whole")).alias("salt")).drop("whole"), ["list", "salt"])
    # what no place or size of the groups' members could allow is not asked
    need = F.expr(f"({NUM} * (n + least) + {NUM + DEN - 1}) div {NUM + DEN}")
    could = (F.col("n") - F.col("at") >= need) & (F.col("left") >= need) & (NUM * F.col("n") <= DEN * F.col("most")) & (NUM * F.col("least") <= DEN * F.col("n"))
    return met.where(could).select("name", "gid")


def _asked(mixed: DataFrame, tasks_: int) -> DataFrame:
    """(name, gid) of all feasible questions of a list, but for those of its largest component, cell by cell."""
    down, across = (F.ceil(F.col(c) / CELL).cast("int") for c in ("asking", "m"))
    grid = mixed.select("*", down.alias("down"), across.alias("across"))
    cell = F.when(F.col("down") * F.col("across") == 1, F.col("list")).otherwise(F.xxhash64("list", "q", "t")).alias("list")
    groups = grid.select("list", "gid", "root", "size", "n", "at", "down", "across").distinct()
    groups = groups.select("*", F.pmod(F.xxhash64("gid"), F.col("across")).cast("int").alias("t"), F.explode(F.sequence(F.lit(0), F.col("down") - 1)).alias("q"))
    asks = grid.where("root != best").select("*", F.pmod(F.xxhash64("name"), F.col("down")).cast("int").alias("q"), F.explode(F.sequence(F.lit(0), F.col("across") - 1)).alias("t"))
    # documents of one group, size and place are alike when asked
    rows = groups.select(cell, F.lit(0).alias("kind"), F.col("gid").alias("id"), "root", "size", "n", "at")
    rows = rows.unionByName(asks.select(cell, F.lit(1).alias("kind"), F.col("name").alias("id"), "root", "size", "n", "at"))
    ready = rows.repartition(tasks_, "list").sortWithinPartitions("list", "kind", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, gids, held = [], [], 0
        for own in _by_list(batches, ("kind", "id", "root", "size", "n", "at")):
            cut = int(np.searchsorted(own["kind"], 1))
            x, y = ({c: v[side] for c, v in own.items()} for side in (slice(0, cut), slice(cut, None)))
            if not cut:
                continue
            starts = np.flatnonzero(np.concatenate(([True], x["id"][1:] != x["id"][:-1])))
            for s, e in zip(starts, np.append(starts[1:], cut), strict=True):
                size, root = x["size"][s], x["root"][s]
                rows = np.flatnonzero((y["size"] < size) | ((y["size"] == size) & (y["root"] < root)))
                ok = np.zeros(len(rows), bool)
                for i in range(s, e):
                    ok |= feasible(y["n"][rows], y["at"][rows], x["n"][i], x["at"][i])
                if ok.any():
                    names.append(np.unique(y["id"][rows[ok]]))
                    gids.append(np.full(len(names[-1]), x["id"][s]))
                    held += len(names[-1])
            if held > 400_000:
                yield _queries(names, gids)
                names, gids, held = [], [], 0
        if held:
            yield _queries(names, gids)

    return ready.mapInArrow(run, "name long, gid long")


def _queries(names: list[np.ndarray], gids: list[np.ndarray]) -> pa.RecordBatch:
    both = np.unique(np.stack((np.concatenate(names), np.concatenate(gids)), 1), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(both[:, i])) for i in (0, 1)], names=["name", "gid"])


def against_groups(queries: DataFrame, of: DataFrame, sets: DataFrame) -> DataFrame:
    """Edges (u, v) of queries to a member of each group that holds a link."""
    salts = queries.groupBy("gid").agg(F.ceil(F.count("*") / SALT).cast("int").alias("salts"))
    asked = queries.join(salts, "gid").select("gid", F.pmod(F.xxhash64("name"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("kind"), "name")
    held = of.join(salts, "gid").select("gid", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("kind"), "name")
    rows = asked.unionByName(held).join(sets, "name").select("gid", "salt", "kind", "name", "tokens")
    ready = rows.repartition(tasks(queries.sparkSession), "gid", "salt").sortWithinPartitions("gid", "salt", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, names, sets, union = None, [], [], None
        for batch in batches:
            u, v = [], []
            for row in batch.to_pylist():
                if (row["gid"], row["salt"]) != group:
                    group, names, sets, union = (row["gid"], row["salt"]), [], [], None
                s = np.frombuffer(row["tokens"], np.uint64)
                if row["kind"] == 0:
                    names.append(row["name"])
                    sets.append(s)
                    continue
                if union is None:
                    union = np.unique(np.concatenate(sets)) if sets else np.zeros(0, np.uint64)
                bound = overlap(s, union)
                if DEN * bound < NUM * len(s):
                    continue
                for name, m in zip(names, sets, strict=True):
                    if bound >= least_overlap(len(s), len(m)) and links(overlap(s, m), len(s), len(m)):
                        u.append(row["name"])
                        v.append(name)
                        break
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return ready.mapInArrow(run, "u long, v long")


def join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id (least doc_id that links reach) of every row."""
    spark, store = docs.sparkSession, Store(docs.sparkSession, "jaccard-join")
    docs = docs.select("doc_id", "text")
    described = store.keep(describe(docs), "described")
    rows, classes, renamed = name_classes(described, store)
    size = classes.agg(F.sum(F.expr(f"n - ({NUM} * n + {DEN - 1}) div {DEN} + 1"))).first()[0] or 0
    parts = max(tasks(spark), -(-size // PART_ENTRIES))
    times = described.where("kind = 1").groupBy("h").agg(F.sum("n").alias("times")).where(F.col("times") >= FREQUENT)
    frequent, hot = filters(times, "h", F.lit(True), F.col("times") >= HOT_PIECE * parts)
    lists = store.keep(postings(docs, frequent, hot, renamed, parts), "lists")
    pairs = store.keep(bounded(first_pairs(lists), classes), "pairs")
    names = store.keep(pairs.select(F.explode(F.array("a", "b")).alias("name")).unionByName(in_long_lists(lists, classes)).distinct(), "names")
    sets = store.keep(candidate_sets(docs, names, renamed), "sets")
    edges = store.keep(in_groups(pairs, sets), "edges")
    roots = components(edges, store, "near")
    for r in range(WITNESS_ROUNDS):
        of = grouped(names, roots, store, f"groups{r}")
        mixed = store.keep(_mixed(lists, of), f"mixed{r}")
        asked = store.keep(open_pairs(None, mixed, of, WITNESSES, r), f"asked{r}")
        store.drop(f"mixed{r}")
        if not asked.limit(1).count():
            break
        edges = edges.unionByName(store.keep(against_groups(asked, of, sets), f"edges{r}"))
        roots = components(edges, store, f"nearer{r}")
    of = grouped(names, roots, store, "groups")
    mixed = store.keep(_mixed(lists, of), "mixed")
    asked = store.keep(open_pairs(pairs, mixed, of), "asked")
    more = store.keep(against_groups(asked, of, sets), "more")
    store.drop("lists", "mixed", "pairs", "sets")
    final = components(edges.unionByName(more), store, "whole")

    placed = rows.join(final.withColumnRenamed("node", "name"), "name", "left").withColumn("root", F.coalesce("root", "name"))
    several = placed.where("n > 0").groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("members")).where("members > 1")
    least_id = store.keep(several.select("root", "component_id"), "least")  # stored for the reason that ``grouped`` gives
    return (
        placed.join(least_id, "root", "left")
        .select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))
    )
