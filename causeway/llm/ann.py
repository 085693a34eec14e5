"""Approximate nearest neighbours by a robust-pruned directed graph for each shard of vectors.

Equal vectors are one row, and rows are dealt to shards by a hash. Shards grow with the root of the number of vectors, which
keeps the sum of building (each vector by its shard) and searching (each query by all shards) least, within a bound of memory.
In each shard, rows of one direction share a node. A node's candidates are the nearest nodes of its shard, by products of
blocks of vectors. Pruning keeps a candidate only if no kept one is closer to it by the relaxed factor ``alpha``, so that edges
stay diverse; edges are then offered in the other direction and pruned again. A quarter of a node's edges lead to nodes drawn
from the whole shard, so that tight groups stay connected. Queries visit every shard by beam search, from the best of
some hundred entries; the scores of what they find are taken again on the original vectors in double precision, and each
query's best are kept over all shards. A node that no path leads to is found with the nearest node that has one.

Every vector is indexed. ``beam`` bounds the candidates held in a search and those that an edge is chosen from, the method's
own accuracy parameter; recall against brute force is measured in the tests.

Cases: vectors that are null, zero, or hold null or non-finite components take no part, neither as queries nor as
candidates; vectors of another length than the query's are never its neighbours; equal vectors tie and come in order of
id; a repeated id is one vector for each different value; with fewer candidates than asked for, all are returned; an
empty table gives no rows.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from causeway.llm.common import dropped, written

#: Nodes of one graph at least, where there are as many, and at most: with 64 dimensions, vectors and edges of the most are some 50 MB.
SHARD_NODES, MOST_NODES = 8192, 65536
#: Values of a shard's vectors at most, which makes shards of longer vectors smaller.
MOST_VALUES = 1 << 23
#: Entries that a search begins from, and nodes that it expands at a time.
ENTRIES, EXPANDED = 512, 4


class Graph:
    """A directed graph over unit vectors for greedy search."""

    def __init__(self, x: np.ndarray, degree: int = 32, beam: int = 64, alpha: float = 1.2, seed: int = 7):
        self.x, self.degree, self.beam, self.alpha = x, degree, beam, alpha
        n = len(x)
        self.edges = np.full((n, degree), -1, np.int32)
        self.start = int(np.argmax(x @ x.mean(axis=0))) if n else 0
        self.entries = np.array([self.start])
        if n:
            self._connect(np.random.default_rng(seed))
            self.entries = self._entries()

    @classmethod
    def of(cls, x: np.ndarray, edges: np.ndarray, entries: np.ndarray) -> "Graph":
        """A graph built before."""
        graph = cls.__new__(cls)
        graph.x, graph.edges, graph.entries = x, edges, entries
        return graph

    def search(self, q: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(nodes, squared distances) of the ``width`` nearest met for each row of q, nearest first; -1 where fewer.

        A candidate is one number: the bits of its distance, which order as distances do, its node, and whether it was expanded.
        """
        n, b = len(self.x), len(q)
        none = np.iinfo(np.int64).max
        seen = np.zeros((b, n + 1), bool)
        seen[:, n] = True  # where an edge is -1
        flat = seen.reshape(-1)

        def packed(gap: np.ndarray, nodes: np.ndarray) -> np.ndarray:
            return (np.maximum(gap, 0, dtype=np.float32).view(np.int32).astype(np.int64) << 32) | (nodes.astype(np.int64) << 1)

        def least(held: np.ndarray) -> np.ndarray:
            return np.partition(held, width - 1, 1)[:, :width] if held.shape[1] > width else held

        beam = least(packed(2 - 2 * (q @ self.x[self.entries].T), self.entries))
        beam = np.concatenate([beam, np.full((b, width - beam.shape[1]), none)], 1)
        np.put_along_axis(seen, np.where(beam < none, (beam & 0xFFFFFFFF) >> 1, n), True, 1)
        active = np.arange(b)
        wide = min(EXPANDED, width)
        while len(active):
            held = beam[active]
            waiting = np.where(held & 1, none, held)
            pick = np.partition(waiting, wide - 1, 1)[:, :wide]
            some = pick.min(1) < none
            if not some.all():
                active, held, waiting, pick = active[some], held[some], waiting[some], pick[some]
                if not len(active):
                    break
            held = np.where(waiting <= pick.max(1, keepdims=True), held | 1, held)
            near = np.where((pick < none)[:, :, None], self.edges[np.where(pick < none, (pick & 0xFFFFFFFF) >> 1, 0)], -1)
            known, place = np.empty(near.shape, bool), active[:, None, None] * (n + 1) + near
            for i in range(wide):  # one after the other, as they may share neighbours; -1 falls on the last of the row before
                known[:, i] = flat.take(place[:, i], mode="wrap")
                flat[place[:, i]] = True
            near, known = near.reshape(len(active), -1), known.reshape(len(active), -1)
            gap = 2 - 2 * np.matmul(np.take(self.x, near, axis=0, mode="wrap"), q[active][:, :, None])[:, :, 0]
            beam[active] = least(np.concatenate([held, np.where(known, none, packed(gap, near))], 1))
        beam.sort(1)
        found = beam < none
        dist = np.where(found, (beam >> 32).astype(np.int32).view(np.float32), np.float32(np.inf))
        return np.where(found, (beam & 0xFFFFFFFF) >> 1, -1).astype(np.int32), dist

    def homes(self) -> np.ndarray:
        """The node by which each node is found: itself, or the nearest one met where no path leads to it."""
        met = self._met()
        home, lost = np.arange(len(self.x)), np.flatnonzero(~met)
        for lo in range(0, len(lost), 512):
            part = lost[lo : lo + 512]
            home[part] = self.search(self.x[part], self.beam)[0][:, 0]
        return home

    def _met(self) -> np.ndarray:
        """Whether a path leads from the start to each node."""
        met = np.zeros(len(self.x), bool)
        front = np.array([self.start])
        while len(front):
            met[front] = True
            near = np.unique(self.edges[front])
            front = near[near >= 0]
            front = front[~met[front]]
        return met

    def _entries(self) -> np.ndarray:
        """The start and nodes spread over those that a path leads to."""
        there = np.flatnonzero(self._met())
        return np.unique(np.append(there[:: max(1, len(there) // ENTRIES)], self.start))

    def _connect(self, rng: np.random.Generator) -> None:
        n, block = len(self.x), 256
        far = self.degree // 4
        near = self.degree - far
        out = np.full((n, near), -1, np.int32)
        for lo in range(0, n, block):
            points = np.arange(lo, min(n, lo + block))
            out[points] = self._prune(points, self._nearest(points), near)
        held = out >= 0
        source, target = np.repeat(np.arange(n), near)[held.ravel()], out[held]
        score = np.empty(len(source), self.x.dtype)
        for lo in range(0, len(source), 1 << 15):
            part = slice(lo, lo + (1 << 15))
            score[part] = np.einsum("kd,kd->k", self.x[source[part]], self.x[target[part]])
        order = np.lexsort((-score, target))
        source, target = source[order], target[order]
        nearest = np.arange(len(target)) - np.searchsorted(target, target) < self.beam  # no more are looked at in pruning
        source, count = source[nearest], np.bincount(target[nearest], minlength=n)
        first = count.cumsum() - count
        for lo in range(0, n, block):
            points = np.arange(lo, min(n, lo + block))
            place = np.arange(count[points].max())
            back = np.full((len(points), len(place)), -1)
            there = place < count[points, None]
            back[there] = source[(first[points, None] + place)[there]]
            kept = self._prune(points, np.concatenate([out[points], back], 1), near)
            drawn = np.sort(rng.integers(0, n, (len(points), far)), 1)
            drawn[:, 1:][drawn[:, 1:] == drawn[:, :-1]] = -1
            drawn[(drawn[:, :, None] == kept[:, None]).any(2) | (drawn == points[:, None])] = -1
            self.edges[points] = np.concatenate([kept, drawn], 1)

    def _nearest(self, points: np.ndarray) -> np.ndarray:
        """Some ``beam`` nearest nodes of each point: those above what the share of them in every 16th node suggests."""
        n = len(self.x)
        score = self.x[points] @ self.x.T
        if n <= 16 * self.beam:
            return np.argpartition(-score, min(self.beam, n - 1), 1)[:, : self.beam + 1]
        some = score[:, ::16]
        at = some.shape[1] - 1 - self.beam // 16
        row, node = np.divmod(np.flatnonzero(score >= np.partition(some, at, 1)[:, at, None]), n)
        count = np.bincount(row, minlength=len(points))
        at = row, np.arange(len(row)) - (count.cumsum() - count)[row]
        pool = np.full((len(points), int(count.max())), -1)
        pool[at] = node
        if pool.shape[1] > 2 * self.beam:  # many may tie
            value = np.full(pool.shape, -np.inf, score.dtype)
            value[at] = score[row, node]
            pool = np.take_along_axis(pool, np.argpartition(-value, 2 * self.beam, 1)[:, : 2 * self.beam], 1)
        return pool

    def _prune(self, points: np.ndarray, pool: np.ndarray, degree: int) -> np.ndarray:
        """The kept neighbours of each point out of the ``beam`` nearest of its row of ``pool`` (-1: none), nearest first."""
        pool = np.sort(pool, 1)
        pool[:, 1:][pool[:, 1:] == pool[:, :-1]] = -1
        gap = np.maximum(2 - 2 * np.matmul(np.take(self.x, pool, axis=0, mode="wrap"), self.x[points][:, :, None])[:, :, 0], 0)
        gap[(pool < 0) | (pool == points[:, None])] = np.inf
        if pool.shape[1] > self.beam:
            best = np.argpartition(gap, self.beam - 1, 1)[:, : self.beam]
            pool, gap = np.take_along_axis(pool, best, 1), np.take_along_axis(gap, best, 1)
        order = np.argsort(gap, 1, kind="stable")
        pool, gap = np.take_along_axis(pool, order, 1), np.take_along_axis(gap, order, 1)
        x = np.take(self.x, pool, axis=0, mode="wrap")
        between = self.alpha * np.maximum(2 - 2 * np.matmul(x, x.transpose(0, 2, 1)), 0)
        alive, keep, count = np.isfinite(gap), np.zeros(gap.shape, bool), np.zeros(len(points), int)
        for i in range(pool.shape[1]):
            keep[:, i] = alive[:, i] & (count < degree)
            count += keep[:, i]
            alive[:, i + 1 :] &= (between[:, i, i + 1 :] > gap[:, i + 1 :]) | ~keep[:, i, None]
        out = np.full((len(points), degree), -1, np.int32)
        row, at = np.nonzero(keep)
        out[row, keep.cumsum(1)[row, at] - 1] = pool[row, at]
        return out


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id and vector (array of float, or of double where it is no float) of the rows that take part; rows can repeat."""
    v = F.col("vector")
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    single = dict(vectors.select(F.col(vector_col).alias("vector")).dtypes)["vector"] == "array<float>"
    return (
        vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<float>" if single else "array<double>").alias("vector"))
        .where(F.col("vec_id").isNotNull() & v.isNotNull() & ~F.coalesce(odd, F.lit(True)) & F.exists(v, lambda x: x != 0))
    )


def classes(vectors: DataFrame, most: int) -> DataFrame:
    """Equal vectors as one row: vector and the ``most`` smallest ids, merged first within each task."""
    schema = vectors.select("vector", F.array("vec_id").alias("ids")).schema

    def local(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list[int]] = {}
        kind = None

        def out():
            values = np.frombuffer(b"".join(held), kind)
            ends = np.cumsum([0, *(len(k) for k in held)]) // values.itemsize
            ids = list(held.values())
            vector = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))
            return pa.RecordBatch.from_arrays([vector, pa.array(ids, pa.list_(pa.int64()))], names=["vector", "ids"])

        for batch in frames:
            column = batch.column(1)
            offsets, values = column.offsets.to_numpy(), column.values.to_numpy() + 0.0  # no negative zeros
            kind = values.dtype
            for i, lo, hi in zip(batch.column(0).to_pylist(), offsets[:-1], offsets[1:]):
                ids = held.setdefault(values[lo:hi].tobytes(), [])
                ids.append(i)
                if len(ids) > 64:
                    ids[:] = sorted(set(ids))[:most]
            if len(held) > 20_000:
                yield out()
                held.clear()
        if held:
            yield out()

    own = lambda ids: F.slice(F.array_sort(F.array_distinct(ids)), 1, most).alias("ids")
    merged = vectors.mapInArrow(local, schema).select("vector", own(F.col("ids")))
    return merged.groupBy("vector").agg(own(F.flatten(F.collect_list("ids"))))


def unit(m: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; by their largest component first, which keeps very long and short ones finite."""
    m = m.astype(np.float64)
    m = m / np.abs(m).max(1, keepdims=True)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def cosine(m: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The cosine of each row with that of ``q``, rounded once from extended precision, so that colinear vectors tie."""
    m, q = m.astype(np.longdouble), q.astype(np.longdouble)
    return ((m * q).sum(1) / (np.sqrt((m * m).sum(1)) * np.sqrt((q * q).sum(1)))).astype(np.float64)


def pack_arrays(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def shard_size(n: int, length: int) -> int:
    """Nodes of a shard. Building costs a vector some 110 + 0.0063 s microseconds (s nodes), and searching, of every 50th, 220 a shard."""
    return int(max(1, min(max(SHARD_NODES, 26 * n**0.5), MOST_NODES, MOST_VALUES // max(1, length))))


def build_index(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    most_ids: int = 6,
    degree: int = 32,
    beam: int = 64,
    alpha: float = 1.2,
    shard_nodes: int | None = None,
) -> DataFrame:
    """One row for each shard and vector length: shard int, most_ids int, graph binary (vectors, ids, counts, first, edges, entries).

    Vectors of one direction, in single precision, share a node, which a search expands to all of them: edges between
    equal points would leave some without a path. A row keeps the ``most_ids`` smallest ids of its equal vectors: as many
    as a search for one less can return.
    """
    kept = written(classes(usable(vectors, id_col, vector_col), most_ids), "ann")
    n, length = kept.agg(F.count("*"), F.coalesce(F.max(F.size("vector")), F.lit(0))).first()
    shards = max(1, -(-n // (shard_nodes or shard_size(n, length))))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list[tuple]] = {}
        shard = None
        for batch in batches:
            if not batch.num_rows:
                continue
            shard, column, ids = batch.column(0)[0].as_py(), batch.column(1), batch.column(2)
            offsets, values, own = column.offsets.to_numpy(), column.values.to_numpy(), ids.offsets.to_numpy()
            size, count, own_ids = np.diff(offsets), np.diff(own), ids.values.to_numpy()[own[0] : own[-1]]
            for length in np.unique(size):
                rows = np.flatnonzero(size == length)
                parts.setdefault(int(length), []).append((values[offsets[rows, None] + np.arange(length)], count[rows], own_ids[np.repeat(size == length, count)]))
        for part in parts.values():
            vectors, count, ids = (np.concatenate(c) for c in zip(*part))
            part.clear()
            nodes, node = np.unique(unit(vectors).astype(np.float32), axis=0, return_inverse=True)
            graph = Graph(nodes, degree, beam, alpha)
            home = graph.homes()[node.ravel()]
            # of a node's vectors, one of its own direction comes first
            order = np.lexsort((node.ravel() != home, home))
            first = np.searchsorted(home[order], np.arange(len(nodes) + 1))
            begin = count.cumsum() - count
            ids = ids[np.repeat(begin[order] - (count[order].cumsum() - count[order]), count[order]) + np.arange(len(ids))]
            # a node that no path leads to has no vectors of its own
            there = np.diff(first) > 0
            renamed = np.where(there, there.cumsum() - 1, -1)
            edges = np.where(graph.edges >= 0, renamed[graph.edges], -1)[there]
            small = np.uint16 if len(edges) < 65535 else np.uint32
            arrays = dict(vectors=vectors[order], ids=ids, counts=count[order].astype(np.uint8 if most_ids < 256 else np.int32))
            arrays |= dict(first=np.append(first[:-1][there], first[-1]).astype(np.int32), edges=edges.astype(small), entries=renamed[graph.entries])
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([most_ids], pa.int32()), pa.array([pack_arrays(**arrays)], pa.binary())], names=["shard", "most_ids", "graph"])

    shard = F.pmod(F.xxhash64("vector"), F.lit(shards)).cast("int").alias("shard")
    dealt = kept.select(shard, "vector", "ids").repartitionById(shards, "shard")
    index = written(dealt.mapInArrow(build, "shard int, most_ids int, graph binary"), "ann")
    dropped(kept)
    return index


def load_graph(blob: bytes) -> tuple[Graph, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The graph of a row of the index, and its vectors, the first of each node, and the ids and the first of each vector."""
    held = np.load(io.BytesIO(blob))
    edges, first = held["edges"], held["first"]
    edges = np.where(edges == np.iinfo(edges.dtype).max, -1, edges.astype(np.int32))
    graph = Graph.of(unit(held["vectors"][first[:-1]]).astype(np.float32), edges.astype(np.int32), held["entries"])
    return graph, held["vectors"], first, held["ids"], np.append(0, held["counts"].astype(np.int64).cumsum())


def ranges(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """lo[0] .. hi[0] - 1, lo[1] .. hi[1] - 1, and so on."""
    n = hi - lo
    return np.repeat(lo - (n.cumsum() - n), n) + np.arange(n.sum())


def nearest(
    index: DataFrame,
    queries: DataFrame,
    k: int = 5,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    beam: int = 64,
    block: int = 128,
) -> DataFrame:
    """The k nearest by cosine of each query among all other ids: query_id, rank, vec_id, score.

    Queries go to every shard, so a task holds one shard's graph and ``block`` queries at a time. A ``k`` for which the index keeps
    too few ids of equal vectors is an error.
    """
    made = index.select("most_ids").first()
    if made and k >= made.most_ids:
        raise ValueError(f"the {k} nearest need an index with most_ids of {k + 1} at least; this one has {made.most_ids}")
    asked = usable(queries, id_col, vector_col).distinct()
    shards = index.select("shard").distinct()
    kind = dict(asked.dtypes)["vector"]
    nothing = lambda t: F.lit(None).cast(t)
    both = index.select("shard", "graph", nothing("long").alias("vec_id"), nothing(kind).alias("vector")).unionByName(
        asked.join(F.broadcast(shards)).select("shard", nothing("binary").alias("graph"), "vec_id", "vector")  # one integer for each some thousand vectors
    )

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graphs: dict[tuple[int, int], tuple] = {}
        for batch in batches:
            for shard, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                if blob.is_valid:
                    graph = load_graph(blob.as_buffer())
                    graphs[shard, graph[0].x.shape[1]] = graph
            asks = batch.filter(batch.column(2).is_valid())
            if not asks.num_rows:
                continue
            column = asks.column(3)
            offsets, values = column.offsets.to_numpy(), column.values.to_numpy()
            shard, own, size = asks.column(0).to_numpy(), asks.column(2).to_numpy(), np.diff(offsets)
            for (at, length), graph in graphs.items():
                rows = np.flatnonzero((shard == at) & (size == length))
                for lo in range(0, len(rows), block):
                    part = rows[lo : lo + block]
                    yield answer(graph, own[part], values[offsets[part, None] + np.arange(length)])

    def answer(held: tuple, own: np.ndarray, asked_for: np.ndarray) -> pa.RecordBatch:
        met, dist = held[0].search(unit(asked_for).astype(np.float32), max(beam, k + 1))
        # k + 1 nodes hold k ids besides the query's, unless it is an id of several vectors; others count where single precision cannot tell
        near = dist <= dist[:, k, None] + 1e-5
        row, vec_id, score = scored(held, own, asked_for, np.where(near, met, -1))
        short = np.bincount(row, minlength=len(own)) < k
        if (short & (met >= 0).any(1) & ~near.all(1)).any():
            row, vec_id, score = scored(held, own, asked_for, np.where(near | short[:, None], met, -1))
        return pa.RecordBatch.from_arrays([pa.array(own[row]), pa.array(vec_id), pa.array(score)], names=["query_id", "vec_id", "score"])

    def scored(held: tuple, own: np.ndarray, asked_for: np.ndarray, met: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        _, vectors, first, ids, id_at = held
        row, col = np.nonzero(met >= 0)
        node = met[row, col]
        row, vector = np.repeat(row, first[node + 1] - first[node]), ranges(first[node], first[node + 1])
        score = np.concatenate([np.empty(0), *(cosine(vectors[vector[i : i + 4096]], asked_for[row[i : i + 4096]]) for i in range(0, len(row), 4096))])
        many = id_at[vector + 1] - id_at[vector]
        row, score, near = np.repeat(row, many), np.repeat(score, many), ids[ranges(id_at[vector], id_at[vector + 1])]
        other = near != own[row]
        row, score, near = row[other], score[other], near[other]
        order = np.lexsort((near, -score, row))
        row, score, near = row[order], score[order], near[order]
        best = np.arange(len(row)) - np.searchsorted(row, row) < k
        return row[best], near[best], score[best]

    # within a part, graphs come first; there is a part for each shard, by its number
    n_shards = shards.agg(F.coalesce(F.max("shard"), F.lit(0))).first()[0] + 1
    dealt = both.repartitionById(n_shards, "shard").sortWithinPartitions(F.col("vec_id").isNotNull())
    met = dealt.mapInArrow(visit, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        met.withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), "score")).alias("score"))
    )
