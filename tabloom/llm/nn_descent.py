"""Approximate nearest neighbours by cosine: NN-descent graph, greedy search.

Vectors of equal components are one node. A few rounds of random hyperplanes give
each node first neighbours; then, round by round, joins bring the neighbours
(and those that name a node as theirs) of every node together, where they are
compared with each other, and better neighbours replace worse ones. Nodes that
the hyperplanes leave with few neighbours, or none, also meet nodes chosen by
hash, so that every node has a place in the graph. Queries walk
the graph: each keeps a beam of its best nodes, joins the neighbours of those
not yet opened, and ends when the beam holds none. The nodes found are scored
again in double precision on the original vectors.

Graph, vectors and beams are tables; no node's list outgrows a fixed length, and
nodes that many others name take a bounded choice of them. What the graph and the
walks compare are vectors rounded to a byte for each component, which is all that
moves between tasks; only the ``RERANK`` best of each query are read as they are.

A node is numbered when the table of nodes is stored, in order of least id and
hash, so that unlike vectors under one id are nodes of their own.

Defined results: vectors that are null, zero, or hold null or non-finite
components take no part; a query never finds its own row; ties go to the smaller
vec_id; rows with a null id take no part; rows that share an id are rows of their
own: each that asks has an answer of its own under that id, and finds the others
of its id; a vector shorter than the longest lacks components that are zero; with
fewer candidates than asked for, all that are found are returned. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabloom.llm.common import Store, tasks

#: Neighbours that a node keeps, and of each kind that meet in a round.
NEIGHBOURS = 24
MEET = 14
#: First rounds of hyperplanes, and nodes of a block that are compared.
FIRST, BLOCK = 6, 1024
ROUNDS = 6
#: A search's beam, and nodes of it opened at a time.
BEAM, OPEN = 512, 128
#: Nodes, chosen by hash, that nodes with few neighbours meet, and where searches start that have no node of their own.
STARTS = 256
#: Nodes of a beam that are measured exactly, at least.
RERANK = 32
SEED = 11

_VECTOR = "array<float>"


def fit_rows(df: DataFrame) -> DataFrame:
    """vec_id and vector of the rows that take part, all of the longest one's length."""
    e = F.col("embedding")
    fit = F.col("vec_id").isNotNull() & e.isNotNull() & (F.size(e) > 0) & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(e, lambda x: x != 0)
    rows = df.where(F.coalesce(fit, F.lit(False))).withColumn("vec_id", F.col("vec_id").cast("long"))
    r = rows.agg(F.min(F.size(e)).alias("least"), F.max(F.size(e)).alias("most")).first()
    vector = F.transform(e, lambda x: x + 0.0)  # a zero has no sign
    if r.least != r.most:
        # null components take no part, so a null one is one that is missing
        vector = F.transform(F.arrays_zip(vector.alias("own"), F.sequence(F.lit(1), F.lit(r.most)).alias("at")), lambda x: F.coalesce(x["own"], F.lit(0.0)))
    return rows.select(*(c for c in rows.columns if c != "embedding"), vector.alias("vector"))


def nodes(rows: DataFrame, keep: int) -> DataFrame:
    """node, vector and the ``keep`` least ids (repeated as they are) of each distinct vector; to be stored before it is used."""
    by = W.partitionBy("vector").orderBy("vec_id")
    # the limit on row numbers holds within tasks before rows move, so a common vector is no hot spot
    few = rows.select("vec_id", "vector").withColumn("r", F.row_number().over(by)).where(F.col("r") <= keep)
    each = few.groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    return each.sortWithinPartitions(F.col("ids")[0], F.xxhash64("vector")).withColumn("node", F.monotonically_increasing_id())


def rounded(vectors: list) -> list[bytes]:
    """A byte for each component, to the largest one's scale."""
    x = np.array(vectors, np.float64)
    return [v.tobytes() for v in np.rint(x / np.abs(x).max(1, keepdims=True) * 127).astype(np.int8)]


def unit(column: list[bytes]) -> np.ndarray:
    """Unit vectors of rounded ones."""
    x = np.frombuffer(b"".join(column), np.int8).reshape(len(column), -1).astype(np.float32)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def whole_keys(batches: Iterator[pa.RecordBatch], key: str, least: int = 32_768) -> Iterator[pa.Table]:
    """Batches sorted by a long key, put together to about so many rows, with all rows of each key in one table."""
    rest, n = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        rest.append(batch)
        n += batch.num_rows
        if n < least:
            continue
        table = pa.Table.from_batches(rest)
        keys = table.column(key).to_numpy()
        if cut := int(np.searchsorted(keys, keys[-1])):
            yield table.slice(0, cut)
            rest, n = table.slice(cut).to_batches(), n - cut
    if rest:
        yield pa.Table.from_batches(rest)


def _table(node, other, sim) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(other, pa.int64()), pa.array(sim, pa.float32())], names=["node", "other", "sim"])


_PAIR = "node long, other long, sim float"


def _best(sims: np.ndarray, ids: np.ndarray, k: int) -> pa.RecordBatch:
    """The k most similar others of every node of a block."""
    np.fill_diagonal(sims, -2)
    k = min(k, len(ids) - 1)
    top = np.argpartition(-sims, k - 1, axis=1)[:, :k] if k < len(ids) - 1 else np.argsort(-sims, axis=1)[:, :k]
    return _table(np.repeat(ids, k), ids[top].ravel(), np.take_along_axis(sims, top, 1).ravel())


def first_graph(units: DataFrame, count: int, dim: int, k: int) -> DataFrame:
    """Pairs of nodes that share a block of random hyperplanes."""
    bits = int(np.ceil(np.log2(count / BLOCK))) + 1 if count > BLOCK else 0
    planes = np.random.default_rng(SEED).standard_normal((FIRST, bits, dim)).astype(np.float32)
    n_parts = tasks(units.sparkSession)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = unit(batch.column("unit").to_pylist())
            for t in range(FIRST):
                c = ((x @ planes[t].T > 0) @ (1 << np.arange(bits)) if bits else np.zeros(len(x))).astype(np.int64) * FIRST + t
                yield pa.RecordBatch.from_arrays([pa.array(c), batch.column("node"), batch.column("unit")], names=["code", "node", "unit"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, ids, held = None, [], []

        def close() -> Iterator[pa.RecordBatch]:
            if len(ids) > 1:
                x = unit(held)
                yield _best(x @ x.T, np.array(ids, np.int64), k)

        for batch in batches:
            for c, i, u in zip(*(batch.column(n).to_pylist() for n in ("code", "node", "unit")), strict=True):
                if c != code or len(ids) >= BLOCK:
                    yield from close()
                    code, ids, held = c, [], []
                ids.append(i)
                held.append(u)
        yield from close()

    coded = units.select("node", "unit").mapInArrow(code, "code long, node long, unit binary")
    # a code of very many nodes is spread over tasks by a hash of the node
    large = coded.groupBy("code").agg(F.ceil(F.count("*") / (4 * BLOCK)).cast("int").alias("salts")).where("salts > 1")
    salt = F.pmod(F.xxhash64("node"), F.coalesce("salts", F.lit(1))).cast("int")
    ready = coded.join(large, "code", "left").withColumn("salt", salt).repartition(n_parts, "code", "salt").sortWithinPartitions("code", "salt", F.xxhash64("node"))
    return ready.select("code", "node", "unit").mapInArrow(compare, _PAIR)


def chosen(units: DataFrame) -> list:
    """Up to ``STARTS`` nodes (node, unit) by the least hashes."""
    return units.orderBy(F.xxhash64("node", F.lit(SEED)), "node").limit(STARTS).collect()


def to_starts(graph: DataFrame, units: DataFrame, starts: list, k: int) -> DataFrame:
    """Pairs, both ways, of nodes with fewer than ``k`` neighbours and the nodes chosen by hash."""
    held = units.sparkSession.sparkContext.broadcast((np.array([r.node for r in starts], np.int64), [bytes(r.unit) for r in starts]))
    short = units.join(graph.where(F.size("others") >= k).select("node"), "node", "left_anti")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, codes = held.value
        for batch in batches:
            if batch.num_rows and len(ids):
                node = batch.column("node").to_numpy()
                sims = unit(batch.column("unit").to_pylist()) @ unit(codes).T
                sims[node[:, None] == ids[None, :]] = -2
                best = np.argsort(-sims, axis=1, kind="stable")[:, :k]
                a, b, s = np.repeat(node, best.shape[1]), ids[best].ravel(), np.take_along_axis(sims, best, 1).ravel()
                a, b, s = a[s > -2], b[s > -2], s[s > -2]
                yield _table(np.concatenate((a, b)), np.concatenate((b, a)), np.concatenate((s, s)))

    return short.select("node", "unit").mapInArrow(run, _PAIR)


def top(pairs: DataFrame, old: DataFrame | None, k: int, was_fresh: int = 0) -> DataFrame:
    """node, others, sims, fresh (not in the old graph, or ``was_fresh``): the k best of each node; one exchange by node."""
    n_parts = tasks(pairs.sparkSession)
    rows = pairs.select("node", "other", "sim", F.lit(1).alias("fresh"))
    if old is not None:
        was = old.select("node", F.explode(F.arrays_zip("others", "sims")).alias("e")).select("node", F.col("e.others").alias("other"), F.col("e.sims").alias("sim"), F.lit(was_fresh).alias("fresh"))
        rows = rows.unionByName(was)
    ready = rows.repartition(n_parts, "node").sortWithinPartitions("node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_keys(batches, "node"):
            yield from lists(table)

    def lists(table: pa.Table) -> Iterator[pa.RecordBatch]:
        node, other, sim, fresh = (table.column(c).to_numpy() for c in ("node", "other", "sim", "fresh"))
        order = np.lexsort((fresh, other, node))  # of a pair the old entry is kept
        node, other, sim, fresh = node[order], other[order], sim[order], fresh[order]
        one = np.concatenate(([True], (node[1:] != node[:-1]) | (other[1:] != other[:-1])))
        node, other, sim, fresh = node[one], other[one], sim[one], fresh[one]
        order = np.lexsort((other, -sim, node))
        node, other, sim, fresh = node[order], other[order], sim[order], fresh[order]
        first = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1])))
        rank = np.arange(len(node)) - np.repeat(first, np.diff(np.append(first, len(node))))
        keep = rank < k
        node, other, sim, fresh = node[keep], other[keep], sim[keep], fresh[keep]
        first = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1])))
        off = np.append(first, len(node)).astype(np.int32)
        for a in range(0, len(first), 5000):
            b = min(a + 5000, len(first))
            cut, o = slice(off[a], off[b]), pa.array(off[a : b + 1] - off[a])
            yield pa.RecordBatch.from_arrays(
                [pa.array(node[first[a:b]])] + [pa.ListArray.from_arrays(o, pa.array(x[cut])) for x in (other, sim, fresh.astype(np.int32))],
                names=["node", "others", "sims", "fresh"],
            )

    return ready.mapInArrow(run, "node long, others array<long>, sims array<float>, fresh array<int>")


def meet(graph: DataFrame, units: DataFrame, round_: int) -> DataFrame:
    """Pairs better than what their nodes have, from neighbours that meet at a common node."""
    edges = graph.select("node", F.posexplode(F.arrays_zip("others", "fresh")).alias("at", "e")).select("node", F.col("e.others").alias("other"), F.col("e.fresh").alias("fresh"))
    ahead = edges.select(F.col("node").alias("center"), F.col("other").alias("member"), "fresh", F.lit(0).alias("back"))
    back = edges.select(F.col("other").alias("center"), F.col("node").alias("member"), "fresh", F.lit(1).alias("back"))
    # of each direction and age a bounded choice meets; row numbers are limited before rows move
    by = W.partitionBy("center", "back", "fresh").orderBy(F.xxhash64("member", F.lit(round_)))
    few = ahead.unionByName(back).withColumn("r", F.row_number().over(by)).where(F.col("r") <= MEET)
    # nothing new can come of a center whose members have all met
    few = few.withColumn("new", F.max("fresh").over(W.partitionBy("center"))).where("new = 1")
    floor = graph.select(F.col("node").alias("member"), F.when(F.size("sims") >= NEIGHBOURS, F.element_at("sims", -1)).otherwise(F.lit(-2.0)).cast("float").alias("least"))
    told = units.withColumnRenamed("node", "member").join(floor, "member", "left").select("member", "unit", F.coalesce("least", F.lit(-2.0)).cast("float").alias("least"))
    chosen = few.groupBy("center", "member").agg(F.max("fresh").alias("fresh"))
    ready = chosen.join(told, "member").repartition(tasks(graph.sparkSession), "center").sortWithinPartitions("center", "member").select("center", "member", "fresh", "least", "unit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_keys(batches, "center", 8192):
            yield from local(table)

    def local(table: pa.Table) -> Iterator[pa.RecordBatch]:
        center, member, fresh, least = (table.column(c).to_numpy() for c in ("center", "member", "fresh", "least"))
        x = unit(table.column("unit").to_pylist())
        first = np.flatnonzero(np.concatenate(([True], center[1:] != center[:-1])))
        ends = np.append(first[1:], len(center))
        found = []
        for a, b in zip(first.tolist(), ends.tolist(), strict=True):
            if b - a < 2 or not fresh[a:b].any():
                continue
            own = x[a:b]
            sims = own @ own.T
            new = fresh[a:b] > 0
            ok = (sims > least[a:b][:, None]) & (new[:, None] | new[None, :])
            np.fill_diagonal(ok, False)
            i, j = np.nonzero(ok)
            if len(i):
                found.append((member[a + i], member[a + j], sims[i, j]))
        if found:
            u, v, s = (np.concatenate([f[n] for f in found]) for n in range(3))
            order = np.lexsort((v, u))
            u, v, s = u[order], v[order], s[order]
            one = np.concatenate(([True], (u[1:] != u[:-1]) | (v[1:] != v[:-1])))
            yield _table(u[one], v[one], s[one])

    return ready.mapInArrow(run, _PAIR)


def build(vectors: DataFrame, store: Store, k: int = NEIGHBOURS, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """The graph (node, others, sims, fresh) and units (node, unit) of frame (node, vector)."""
    dim = vectors.select(F.max(F.size("vector"))).first()[0] or 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(rounded(batch.column("vector").to_pylist()), pa.binary())], names=["node", "unit"])

    units = store.keep(vectors.select("node", "vector").mapInArrow(run, "node long, unit binary"), "units")
    count = units.count()
    blocks = store.keep(top(first_graph(units, count, dim, k), None, k), "blocks")
    graph = store.keep(top(to_starts(blocks, units, chosen(units), min(k, max(count - 1, 1))), blocks, k, 1), "graph0")
    store.drop("blocks")
    for r in range(1, rounds + 1):
        graph = store.keep(top(meet(graph, units, r), graph, k), f"graph{r}")
        store.drop(f"graph{r - 1}")
        news = graph.agg(F.sum(F.aggregate("fresh", F.lit(0), lambda a, x: a + x))).first()[0] or 0
        if news <= 0.002 * k * count:
            break
    return graph, units


def search(queries: DataFrame, graph: DataFrame, units: DataFrame, store: Store, start: DataFrame | None = None, beam: int = BEAM, opened: int = OPEN) -> DataFrame:
    """query, node, sim: the beams of greedy search for frame (query, unit).

    A walk starts from ``start`` (query, node), or else from nodes chosen by hash.
    """
    n_parts = tasks(queries.sparkSession)
    if start is None:
        start = queries.select("query", F.explode(F.lit([r.node for r in chosen(units)]).cast("array<long>")).alias("node"))
    ask = queries.select("query", F.col("unit").alias("ask"))

    def sims(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (unit(batch.column(c).to_pylist()) for c in ("ask", "unit"))
                yield pa.RecordBatch.from_arrays([batch.column("query"), batch.column("node"), pa.array(np.einsum("ij,ij->i", a, b), pa.float32()), pa.array(np.zeros(len(a), np.int32))], names=["query", "node", "sim", "opened"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_keys(batches, "query"):
            yield beams_of(table)

    def beams_of(table: pa.Table) -> pa.RecordBatch:
        query, node, sim, done = (table.column(c).to_numpy() for c in ("query", "node", "sim", "opened"))
        order = np.lexsort((-done, node, query))
        query, node, sim, done = query[order], node[order], sim[order], done[order]
        one = np.concatenate(([True], (query[1:] != query[:-1]) | (node[1:] != node[:-1])))
        query, node, sim, done = query[one], node[one], sim[one], done[one]
        order = np.lexsort((node, -sim, query))
        query, node, sim, done = query[order], node[order], sim[order], done[order]
        first = np.flatnonzero(np.concatenate(([True], query[1:] != query[:-1])))
        keep = np.arange(len(query)) - np.repeat(first, np.diff(np.append(first, len(query)))) < beam
        query, node, sim, done = query[keep], node[keep], sim[keep], done[keep]
        # the best nodes not opened are next: 2 now, 1 opened before, 0 waits
        state = np.where(done > 0, 1, 0).astype(np.int32)
        wait = np.flatnonzero(state == 0)
        if len(wait):
            first = np.flatnonzero(np.concatenate(([True], query[wait][1:] != query[wait][:-1])))
            rank = np.arange(len(wait)) - np.repeat(first, np.diff(np.append(first, len(wait))))
            state[wait[rank < opened]] = 2
        return pa.RecordBatch.from_arrays([pa.array(query), pa.array(node), pa.array(sim), pa.array(state)], names=["query", "node", "sim", "opened"])

    schema = "query long, node long, sim float, opened int"

    def merged(rows: DataFrame) -> DataFrame:
        return rows.repartition(n_parts, "query").sortWithinPartitions("query").mapInArrow(merge, schema)

    def scored(pairs: DataFrame) -> DataFrame:
        return pairs.join(units, "node").join(ask, "query").select("query", "node", "ask", "unit").mapInArrow(sims, schema)

    beams = store.keep(merged(scored(start.distinct())), "beam0")
    step = 0
    while beams.where("opened = 2").limit(1).count():
        step += 1
        out = beams.where("opened = 2").select("query", "node").join(graph.select("node", "others"), "node").select("query", F.explode("others").alias("node")).distinct()
        fresh = out.join(beams.select("query", "node"), ["query", "node"], "left_anti")
        beams = store.keep(merged(beams.unionByName(scored(fresh))), f"beam{step}")
        store.drop(f"beam{step - 1}")
    return beams.select("query", "node", "sim")


def nearest(df: DataFrame, asks: Column, k: int = 5, beam: int = BEAM) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found of each row that ``asks``, without itself."""
    store = Store(df.sparkSession, "nn-descent")
    own = "asks"
    rows = fit_rows(df.select("vec_id", "embedding", F.coalesce(asks, F.lit(False)).alias(own)))
    each = store.keep(nodes(rows, k + 1), "nodes")
    graph, units = build(each.select("node", "vector"), store)
    asking = rows.where(own).select(F.col("vec_id").alias("query_id"), "vector")
    # every query's vector is a node: the walk starts there
    of = asking.join(each.select("vector", "node"), "vector").select("query_id", F.col("node").alias("query"))
    of = store.keep(of.withColumn("row", F.monotonically_increasing_id()), "queries")
    walkers = of.select("query").distinct().join(units.withColumnRenamed("node", "query"), "query")
    around = graph.select("node", F.explode(F.slice("others", 1, NEIGHBOURS)).alias("other"))
    start = walkers.select("query").join(around, F.col("query") == F.col("node")).select("query", F.col("other").alias("node")).unionByName(walkers.select("query", F.col("query").alias("node")))
    # a node of few neighbours, whatever became of it, also starts from those chosen by hash
    least = min(NEIGHBOURS, max(units.count() - 1, 0))
    short = walkers.select("query").join(graph.where(F.size("others") >= least).select(F.col("node").alias("query")), "query", "left_anti")
    start = start.unionByName(short.select("query", F.explode(F.lit([r.node for r in chosen(units)]).cast("array<long>")).alias("node")))
    found = search(walkers, graph, units, store, start, beam)
    by = W.partitionBy("query").orderBy(F.desc("sim"), "node")
    close = found.withColumn("r", F.row_number().over(by)).where(F.col("r") <= max(2 * k + 2, RERANK)).select("query", "node")
    vectors = each.select("node", "vector", "ids")

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (np.array(batch.column(c).to_pylist(), np.float64) for c in ("ask", "vector"))
                s = (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))
                yield pa.RecordBatch.from_arrays([batch.column("query"), batch.column("node"), batch.column("ids"), pa.array(s)], names=["query", "node", "ids", "score"])

    asked = vectors.select(F.col("node").alias("query"), F.col("vector").alias("ask"))
    measured = close.join(vectors, "node").join(asked, "query").select("query", "ask", "node", "vector", "ids").mapInArrow(exact, "query long, node long, ids array<long>, score double")
    # the k + 1 least ids of the k + 1 best nodes hold the k best rows beside the query's own, which is one of its node's with its id
    last = W.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    told = measured.select("query", "node", "score", "ids", F.posexplode("ids").alias("at", "vec_id"))
    mine = (F.col("node") == F.col("query")) & (F.array_position("ids", F.col("query_id")) == F.col("at") + 1)
    each_query = of.join(told, "query").where(~mine)
    return each_query.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
