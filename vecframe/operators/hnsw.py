"""Approximate search by hierarchical proximity graphs, one for each shard of the rows (after Malkov and Yashunin, 2016).

A shard is the rows of one hash of the id, SHARD_ROWS of them or so at the most; every shard is built and searched
on its own, and the shards' results are merged. An index is a DataFrame of one row a shard, in packed arrays: ids,
vectors, and for each layer its nodes and their links. It can be written as Parquet, and a search reads it without a
shuffle: shards pass by as they lie, and each meets a block of queries.

Layers: a node's highest layer comes from a hash of its id, so a rebuilt graph is the same; a part of a layer that
links don't connect to others sends its first node one layer up. Links: of a node's nearest in its layer, found by
matrix products, those nearer to it than to another one that is linked already, then the nearest of the rest; and
back. A search runs all queries of a block at once: from the top, a beam in each layer gives the starts of the next.
Deleted ids are passed through, not returned; a beam that holds too many of them is widened until k are left.
A beam of a quarter of the rows or more would meet nearly all nodes for each query: then the links are followed once
for all queries, both ways, and all the rows that they connect are compared by matrix products.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .search import FEW, _per_query, block_distances, bounds, closest_of_many, in_blocks, least, matrix, merged

M, EF_BUILD, EF_SEARCH = 12, 200, 50
SHARD_ROWS = 12_500
#: Candidates for each link; nodes that a beam expands at once; distances that a task holds at once; times a beam's
#: width up to which a graph is followed as a whole.
CANDIDATES, STEP, HELD, WHOLE = 4, 4, 8_000_000, 4
#: Nodes that are linked at once; distances in a group of which the least is looked at first.
LINKED, GROUP = 128, 16
#: Queries that are compared with a graph followed as a whole at once; deleted ids that go to all tasks; results that a
#: task keeps from shard to shard; tasks for each core where there are more shards.
TOGETHER, GONE, KEPT, TASKS = 8_192, 2_000_000, 2_000_000, 4
INDEX = "shard int, shards int, dims int, ids binary, vecs binary, layers array<struct<nodes: binary, links: binary>>"


def levels(ids: np.ndarray, m: int) -> np.ndarray:
    """Geometric by a hash of the id."""
    x = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x7F4A7C15)
    for factor, shift in ((0xBF58476D1CE4E5B9, 30), (0x94D049BB133111EB, 27)):
        x = (x ^ x >> np.uint64(shift)) * np.uint64(factor)
    u = ((x ^ x >> np.uint64(31)) >> np.uint64(11)).astype(np.float64) / (1 << 53)
    return np.floor(-np.log(np.maximum(u, 1e-18)) / math.log(max(m, 2))).astype(np.int32)


def prepared(x: np.ndarray, metric: str) -> np.ndarray:
    """Vectors as the graph compares them: of length 1 for cosine distances."""
    if metric == "cosine":
        size = np.linalg.norm(x, axis=1, keepdims=True)
        x = x / np.where(size == 0, 1, size)
    return np.ascontiguousarray(x, np.float32)


def _near(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Ordering distances of prepared vectors, over the last axis."""
    if metric == "l2":
        d = a - b
        return np.einsum("...i,...i->...", d, d)
    return -np.einsum("...i,...i->...", a, b)


def _sortable(d: np.ndarray) -> np.ndarray:
    """Integers of 32 bits in the order of single-precision numbers."""
    bits = d.view(np.int32).astype(np.int64)
    return np.where(bits < 0, bits ^ 0x7FFFFFFF, bits)


def _least(d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of the k least of each row of d, in order.

    Every m-th value makes a group; the k-th least of the groups' minima is no less than the k-th value, so few are sorted.
    NaN counts as infinite, and is replaced in d.
    """
    n = d.shape[1]
    m = n // GROUP if n >= 4 * GROUP * k else n
    size = n // m
    low = d[:, : m * size].reshape(len(d), size, m).min(axis=1)
    if np.isnan(low).any() or np.isnan(d[:, m * size :]).any():
        d[np.isnan(d)] = np.inf
        low = d[:, : m * size].reshape(len(d), size, m).min(axis=1)
    last = np.partition(low, k - 1, axis=1)[:, k - 1]
    row, group = np.divmod(np.flatnonzero(low <= last[:, None]), m)
    at = (row * n + group)[:, None] + m * np.arange(size)
    at = at[np.take(d, at) <= last[row, None]]
    rest = np.nonzero(d[:, m * size :] <= last[:, None])
    at = np.concatenate([at, rest[0] * n + m * size + rest[1]])
    row, value = at // n, np.take(d, at)
    order = np.argsort((row << 32) + _sortable(value), kind="stable")
    many = np.bincount(row, minlength=len(d))
    order = order[(np.cumsum(many) - many)[:, None] + np.arange(k)]
    return at[order] % n, value[order]


def _chosen(one: np.ndarray, other: np.ndarray, own: np.ndarray, wide: int, cap: int, held: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """Of each own node cap neighbours: those nearer to it than to a chosen one, then the nearest of the rest; and distances.

    The products of rows of one and other are distances; held has room for them.
    """
    d = np.matmul(one[own], other.T, out=held[: len(own)])
    d[np.arange(len(own)), own] = np.inf
    near, d = _least(d, wide)
    some = one[near]
    between = some @ (other[near] if metric == "l2" else -some).transpose(0, 2, 1)  # of the candidates with each other
    rows, left, apart = np.arange(len(own)), d < np.inf, np.zeros(d.shape, bool)
    for _ in range(cap):
        first = left.argmax(axis=1)
        apart[rows, first] |= left[rows, first]
        left[rows, first] = False
        if not left.any():
            break
        left &= d < between[rows, first]
    place = np.sort(np.argsort(~apart, axis=1, kind="stable")[:, :cap], axis=1)
    return np.take_along_axis(near, place, 1), np.take_along_axis(d, place, 1)


def _links(x: np.ndarray, metric: str, cap: int, width: int) -> np.ndarray:
    """Of each node up to 2 * cap neighbours (-1: none)."""
    n = len(x)
    wide = min(max(cap + 1, min(width, CANDIDATES * cap)), n - 1)
    out = np.full((n, 2 * cap), -1, np.int32)
    if wide <= 0:
        return out
    cap = min(cap, wide)
    far = np.empty((n, cap), np.float32)
    if metric == "l2":
        size, ones = np.einsum("ij,ij->i", x, x)[:, None], np.ones((n, 1), np.float32)
        one, other = np.hstack([x, size, ones]), np.hstack([-2 * x, ones, size])
    else:
        one, other = x, -x
    step = max(1, min(LINKED, HELD // n))
    held = np.empty((step, n), np.float32)
    for at in range(0, n, step):
        own = np.arange(at, min(n, at + step))
        out[own, :cap], far[own] = _chosen(one, other, own, wide, cap, held, metric)
    # And back: to each node those that chose it and that it didn't choose, the nearest first.
    a, b, d = [], [], []
    for i in range(0, n, 10_000):
        to = out[i : i + 10_000, :cap]
        mutual = (out[to, :cap] == np.arange(i, i + len(to))[:, None, None]).any(axis=2)
        own, at = np.nonzero(~mutual)
        a.append(to[own, at]), b.append(own + i), d.append(far[own + i, at])
    a, b, d = np.concatenate(a).astype(np.int64), np.concatenate(b), np.concatenate(d)
    order = np.argsort((a << 32) + _sortable(d), kind="stable")
    a, b = a[order], b[order]
    place = cap + np.arange(len(a)) - np.searchsorted(a, np.arange(n))[a]
    fits = place < out.shape[1]
    out[a[fits], place[fits]] = b[fits]
    return out


def _parts(links: np.ndarray) -> np.ndarray:
    """Of each node the first node of what it is connected with."""
    n = len(links)
    a, at = np.nonzero(links >= 0)
    b, root = links[a, at], np.arange(n)
    while True:
        least = root.copy()
        np.minimum.at(least, a, root[b])
        np.minimum.at(least, b, root[a])
        least = least[least]
        if np.array_equal(least, root):
            return root
        root = least


class Graph:
    """The layers over the rows of a matrix: (nodes, links by place among them), from the lowest on."""

    def __init__(self, x: np.ndarray, metric: str, layers: list[tuple[np.ndarray, np.ndarray]]):
        self.x, self.metric, self.layers = prepared(x, metric), metric, layers

    @classmethod
    def build(cls, x: np.ndarray, metric: str, ids: np.ndarray, m: int = M, width: int = EF_BUILD) -> Graph:
        out, high, nodes, layer = cls(x, metric, []), levels(ids, m), np.arange(len(x)), 0
        while len(nodes):
            links = _links(out.x[nodes], metric, 2 * m if layer == 0 else m, width)
            out.layers.append((nodes.astype(np.int32), links))
            roots = np.unique(_parts(links))
            up = high[nodes] > layer
            if len(roots) > 1:
                up[roots] = True
            if up.all():
                break
            nodes, layer = nodes[up], layer + 1
        return out

    def beam(self, q: np.ndarray, starts: np.ndarray, width: int, layer: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each query (prepared) the nearest found from starts (places in the layer, -1: none), as places and distances."""
        nodes, links = self.layers[layer]
        x, many, ends = self.x, len(q), len(nodes)
        width = min(width, ends)
        seen = np.zeros((many, ends), bool)
        rows, at = np.nonzero(starts >= 0)
        place = np.full((many, max(width, starts.shape[1])), -1, np.int64)
        far = np.full(place.shape, np.inf, np.float32)
        found = starts[rows, at]
        place[rows, at], far[rows, at] = found, _near(x[nodes[found]], q[rows], self.metric)
        seen[rows, found] = True
        done = place < 0
        while True:
            open_ = np.where(done, np.inf, far)
            step = min(STEP, open_.shape[1])
            pick = np.argpartition(open_, step - 1, axis=1)[:, :step]
            rows, at = np.nonzero(np.isfinite(np.take_along_axis(open_, pick, 1)))
            if not len(rows):
                break
            at = pick[rows, at]
            done[rows, at] = True
            to = links[place[rows, at]]
            own = np.repeat(rows, to.shape[1])
            to = to.ravel()
            own, to = own[to >= 0], to[to >= 0]
            fresh = ~seen[own, to]
            own, to = own[fresh], to[fresh]
            pair = np.unique(own * ends + to)  # one node may be reached from several
            own, to = pair // ends, pair % ends
            seen[own, to] = True
            if not len(own):
                continue
            d = _near(x[nodes[to]], q[own], self.metric)
            first = np.searchsorted(own, np.arange(many))
            slot = np.arange(len(own)) - first[own]
            more = int(slot.max()) + 1
            place = np.concatenate([place, np.full((many, more), -1)], axis=1)
            far = np.concatenate([far, np.full((many, more), np.inf, np.float32)], axis=1)
            done = np.concatenate([done, np.ones((many, more), bool)], axis=1)
            slot += place.shape[1] - more
            place[own, slot], far[own, slot], done[own, slot] = to, d, False
            if place.shape[1] > width:
                best = np.argpartition(far, width - 1, axis=1)[:, :width]
                place, far, done = (np.take_along_axis(z, best, 1) for z in (place, far, done))
        return place, far

    def search(self, q: np.ndarray, width: int) -> np.ndarray:
        """Of each query the nodes of the lowest layer's beam (-1: none)."""
        if not self.layers:
            return np.zeros((len(q), 0), np.int64)
        q, top = prepared(q, self.metric), len(self.layers) - 1
        starts = np.zeros((len(q), 1), np.int64)
        for layer in range(top, 0, -1):
            place, _ = self.beam(q, starts, max(1, width // 4), layer)
            below = np.searchsorted(self.layers[layer - 1][0], self.layers[layer][0])
            starts = np.where(place >= 0, below[place], -1)
        return self.beam(q, starts, width, 0)[0]

    def reached(self) -> np.ndarray:
        """The nodes of the lowest layer that links connect, layer by layer, with the first node of the top."""
        found = np.zeros(min(1, len(self.x)), np.int64)
        for layer in range(len(self.layers) - 1, -1, -1):
            nodes, links = self.layers[layer]
            part = _parts(links)
            found = np.flatnonzero(np.isin(part, part[found]))
            if layer:
                found = np.searchsorted(self.layers[layer - 1][0], nodes[found])
        return found



def build(df: DataFrame, metric: str = "l2", m: int = M, ef_construction: int = EF_BUILD, shards: int | None = None, id: str = "id", vec: str = "vec") -> DataFrame:
    """The index of the rows, one row a shard (INDEX). shards: at the least; more where they would hold over SHARD_ROWS."""
    n = max(shards or 1, math.ceil(df.count() / SHARD_ROWS))

    def run(table: pa.Table) -> pa.Table:
        table = table.take(pa.array(np.argsort(table.column("id").to_numpy(), kind="stable")))
        ids, x = table.column("id").to_numpy(), matrix(table.column("vec"))
        graph = Graph.build(x, metric, ids, m, ef_construction)
        layers = [{"nodes": nodes.tobytes(), "links": links.tobytes()} for nodes, links in graph.layers]
        row = {"shard": table.column("shard")[0].as_py(), "shards": n, "dims": x.shape[1], "ids": ids.astype("<i8").tobytes(), "vecs": x.astype("<f4").tobytes(), "layers": layers}
        kinds = [("shard", pa.int32()), ("shards", pa.int32()), ("dims", pa.int32()), ("ids", pa.binary()), ("vecs", pa.binary()), ("layers", pa.list_(pa.struct([("nodes", pa.binary()), ("links", pa.binary())])))]
        return pa.Table.from_pylist([row], pa.schema(kinds))

    # Dealt by hash, some tasks would get several shards and others none.
    spark = df.sparkSession
    tasks = min(n, max(TASKS * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    rows = df.select(_shard(F.col(id).cast("long"), n).alias("shard"), F.col(id).cast("long").alias("id"), F.col(vec).alias("vec"))
    dealt = rows.withColumn("task", F.col("shard") % tasks).repartitionById(tasks, F.col("task"))
    return dealt.groupBy("task", "shard").applyInArrow(run, INDEX)


def _shard(id: F.Column, n: int | F.Column) -> F.Column:
    return F.pmod(F.xxhash64(id), F.lit(n) if isinstance(n, int) else n).cast("int")


def _opened(row: dict, metric: str) -> tuple[np.ndarray, np.ndarray, Graph]:
    ids = np.frombuffer(row["ids"], "<i8")
    x = np.frombuffer(row["vecs"], "<f4").reshape(len(ids), row["dims"])
    layers = [(nodes := np.frombuffer(y["nodes"], np.int32), np.frombuffer(y["links"], np.int32).reshape(len(nodes), -1)) for y in row["layers"]]
    return ids, x, Graph(x, metric, layers)


def search(index: DataFrame, queries: Sequence[tuple[int, Sequence[float]]], k: int, metric: str = "l2", ef_search: int = EF_SEARCH, deleted: DataFrame | None = None) -> DataFrame:
    """qid, id, distance, rank for each (qid, query): every shard's beam, then the best of them.

    deleted: ids (column id) to leave out; up to GONE go to the tasks, of more each shard gets its own.
    """
    names, q = np.array([x[0] for x in queries], np.int64), np.array([x[1] for x in queries], np.float64)
    given, left_out = index.withColumn("gone", F.lit(None).cast("array<long>")), np.zeros(0, np.int64)
    if deleted is not None:
        left_out = deleted.select(F.col("id").cast("long").alias("id")).where("id is not null").limit(GONE + 1).toArrow().column("id").to_numpy()
    if len(left_out) > GONE:
        left_out = left_out[:0]
        number = index.select("shards").first()
        own = deleted.select(_shard(F.col("id").cast("long"), number.shards if number else 1).alias("shard"), F.col("id").cast("long").alias("id"))
        given = index.join(own.groupBy("shard").agg(F.collect_set("id").alias("gone")), "shard", "left")

    many = len(names) > FEW

    def packed(i: np.ndarray, near: np.ndarray, d: np.ndarray) -> pa.RecordBatch:
        if not many:
            return pa.RecordBatch.from_arrays([pa.array(names[i]), pa.array(near), pa.array(d)], ["qid", "id", "d"])
        first = np.flatnonzero(np.diff(i, prepend=i[:1] - 1))
        ends = pa.array(np.append(first, len(i)).astype(np.int32))
        return pa.RecordBatch.from_arrays([pa.array(names[i[first]]), pa.ListArray.from_arrays(ends, pa.array(near)), pa.ListArray.from_arrays(ends, pa.array(d))], ["qid", "id", "d"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, bound = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)), np.full(len(q), np.inf)
        for row in (r for b in batches for i in range(b.num_rows) for r in b.slice(i, 1).to_pylist()):
            ids, x, graph = _opened(row, metric)
            gone = np.isin(ids, row["gone"] or left_out)
            step, whole, found = max(1, HELD // max(1, len(ids))), None, []
            if WHOLE * max(ef_search, k) >= len(ids):
                step = TOGETHER
            for at in range(0, len(q), step):
                todo, width, out = np.arange(at, min(len(q), at + step)), max(ef_search, k), []
                while len(todo):
                    if WHOLE * width >= len(ids):
                        if whole is None:
                            whole = graph.reached()
                            whole = whole[~gone[whole]]
                            held = x[whole].astype(np.float64)
                        i, near, d = closest_of_many(metric, held, ids[whole], q[todo], k, bound[todo])
                        out.append((todo[i], near, d))
                        break
                    nodes = graph.search(q[todo], width)
                    live = (nodes >= 0) & ~gone[nodes]
                    enough = live.sum(axis=1) >= min(k, len(ids) - int(gone.sum())) if gone.any() and width < len(ids) else np.ones(len(todo), bool)
                    for i in np.flatnonzero(enough).tolist():
                        some = nodes[i, live[i]]
                        d = block_distances(metric, x[some].astype(np.float64), q[todo[i], None])[0]
                        best = np.lexsort((ids[some], d))[:k]
                        out.append((np.full(len(best), todo[i]), ids[some[best]], d[best]))
                    todo, width = todo[~enough], 2 * width
                if out and many and len(q) * k <= KEPT:
                    found += out
                elif out:
                    yield packed(*(np.concatenate(x) for x in zip(*out, strict=True)))
            if found:
                kept = least(*(np.concatenate(x) for x in zip(kept, *found, strict=True)), k)
                bound = bounds(kept, len(q), k)
        for at in range(0, len(kept[0]), k * TOGETHER):
            yield packed(*(x[at : at + k * TOGETHER] for x in kept))

    given = given.select("shard", "dims", "ids", "vecs", "layers", "gone")
    if many:
        return merged(given.mapInArrow(run, "qid long, id array<long>, d array<double>"), metric, k)
    return _per_query(given.mapInArrow(run, "qid long, id long, d double"), metric, k)


def search_frame(index: DataFrame, queries: DataFrame, k: int, metric: str = "l2", ef_search: int = EF_SEARCH, deleted: DataFrame | None = None) -> DataFrame:
    """The same for every row of queries (qid, qvec), in blocks."""
    first = queries.first()
    out = None if first is None else in_blocks(queries, len(first.qvec), lambda held: search(index, held, k, metric, ef_search, deleted))
    return out if out is not None else index.sparkSession.createDataFrame([], "qid long, id long, distance double, rank int")


def edges(index: DataFrame) -> DataFrame:
    """The graph as rows: shard, layer, id, neighbour."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for b in batches for i in range(b.num_rows) for r in b.slice(i, 1).to_pylist()):
            ids, _, graph = _opened(row, "l2")
            for layer, (nodes, links) in enumerate(graph.layers):
                a, at = np.nonzero(links >= 0)
                n = len(a)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, row["shard"], np.int32)), pa.array(np.full(n, layer, np.int32)), pa.array(ids[nodes[a]]), pa.array(ids[nodes[links[a, at]]])], ["shard", "layer", "id", "neighbour"])

    return index.select("shard", "dims", "ids", "vecs", "layers").mapInArrow(run, "shard int, layer int, id long, neighbour long")


def rows(index: DataFrame) -> DataFrame:
    """id, vec of the rows that the index holds."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for b in batches for i in range(b.num_rows) for r in b.slice(i, 1).to_pylist()):
            ids, x, _ = _opened(row | {"layers": []}, "l2")
            for at in range(0, len(ids), 10_000):
                part = x[at : at + 10_000]
                yield pa.RecordBatch.from_arrays([pa.array(ids[at : at + 10_000]), pa.FixedSizeListArray.from_arrays(pa.array(part.ravel()), row["dims"]).cast(pa.list_(pa.float32()))], ["id", "vec"])

    return index.select("shard", "dims", "ids", "vecs").mapInArrow(run, "id long, vec array<float>")


__all__ = ["Graph", "build", "edges", "levels", "rows", "search", "search_frame"]
