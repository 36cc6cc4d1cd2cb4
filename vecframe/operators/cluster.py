"""k-means, inverted-file search, product quantisation, and their combination.

Centroids and codebooks are bounded by their parameters (lists x dimensions), so they go to the tasks with the
closure; rows never leave the executors but as one partial sum a cluster and task.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidConfig
from ..functions import metrics
from .search import _per_query, _rank, block_distances, in_blocks, knn, matrix

LISTS, PROBES, PASSES = 256, 16, 10
SUBSPACES, CODES, PQ_PASSES = 8, 256, 25


def sample(df: DataFrame, n: int, id: str = "id", seed: int = 42) -> DataFrame:
    """The n rows of the least hashes of id (all, if fewer), to train on."""
    return df.orderBy(F.xxhash64(F.lit(seed), id), id).limit(n)


def seeds(df: DataFrame, n: int, id: str = "id", vec: str = "vec", seed: int = 42) -> np.ndarray:
    """n distinct rows' vectors (all, if fewer), chosen by a hash of their id."""
    rows = df.select(F.col(id).alias("id"), F.col(vec).alias("vec")).orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(n).collect()
    return np.array([r.vec for r in rows], np.float64)


def assign(df: DataFrame, centroids: np.ndarray, metric: str = "l2", id: str = "id", vec: str = "vec", keep: Sequence[str] = ()) -> DataFrame:
    """id, list_id (the nearest centroid, the first of equals), vec, and keep."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = block_distances(metric, matrix(batch.column(1), centroids.shape[1]), centroids).argmin(axis=0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(near.astype(np.int32)), *batch.columns[1:]], ["id", "list_id", "vec", *keep])

    kinds = "".join(f", {c} {df.schema[c].dataType.simpleString()}" for c in keep)
    return df.select(F.col(id).cast("long").alias("id"), F.col(vec).alias("vec"), *keep).mapInArrow(run, f"id long, list_id int, vec {df.schema[vec].dataType.simpleString()}{kinds}")


def _sums(df: DataFrame, centroids: np.ndarray, metric: str, vec: str) -> tuple[np.ndarray, np.ndarray]:
    k, dims = centroids.shape

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((k, dims)), np.zeros(k, np.int64)
        for batch in batches:
            x = matrix(batch.column(0), dims)
            near = block_distances(metric, x, centroids).argmin(axis=0)
            np.add.at(total, near, x)
            count += np.bincount(near, minlength=k)
        full = np.flatnonzero(count)
        at = np.repeat(full, dims)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(np.tile(np.arange(dims, dtype=np.int32), len(full))), pa.array(total[full].ravel()), pa.array(count[at])], ["c", "d", "s", "n"])

    rows = df.select(vec).mapInArrow(run, "c int, d int, s double, n long").groupBy("c", "d").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect()
    total, count = np.zeros((k, dims)), np.zeros(k, np.int64)
    for r in rows:  # clusters x dimensions
        total[r.c, r.d], count[r.c] = r.s, r.n
    return total, count


def kmeans_step(df: DataFrame, centroids: np.ndarray, metric: str = "l2", vec: str = "vec") -> np.ndarray:
    """The means of what is nearest to each centroid; an empty cluster keeps its centroid."""
    total, count = _sums(df, centroids, metric, vec)
    out = centroids.copy()
    out[count > 0] = total[count > 0] / count[count > 0, None]
    return out


def kmeans(df: DataFrame, k: int, metric: str = "l2", passes: int = PASSES, id: str = "id", vec: str = "vec", start: np.ndarray | None = None, seed: int = 42) -> np.ndarray:
    """Lloyd's centroids from seeded rows (or from start); stops when they no longer move."""
    if k < 1:
        raise InvalidConfig("at least one cluster is needed")
    now = seeds(df, k, id, vec, seed) if start is None else np.asarray(start, np.float64)
    for _ in range(passes):
        then = kmeans_step(df, now, metric, vec)
        if np.allclose(then, now, atol=0, rtol=0):
            break
        now = then
    return now


def probed_lists(centroids: np.ndarray, query: Sequence[float], probes: int, metric: str) -> list[int]:
    d = block_distances(metric, centroids, np.array([query], np.float64))[0]
    return np.argsort(d, kind="stable")[: max(0, probes)].tolist()


def ivf_search(lists: DataFrame, centroids: np.ndarray, query: Sequence[float], k: int, probes: int = PROBES, metric: str = "l2", keep: Sequence[str] = ()) -> DataFrame:
    """Exact within the probed lists of ``lists`` (id, list_id, vec): partitions, where it is written by list_id."""
    metrics.check_dimensions(query, centroids.shape[1])
    return knn(lists.where(F.col("list_id").isin(probed_lists(centroids, query, probes, metric))), query, k, metric, keep=keep)


def ivf_search_batch(lists: DataFrame, centroids: np.ndarray, queries: Sequence[tuple[int, Sequence[float]]], k: int, probes: int = PROBES, metric: str = "l2") -> DataFrame:
    """qid, id, distance, rank for a block of (qid, query): each list's rows meet the queries that probe it."""
    names, q = np.array([x[0] for x in queries], np.int64), np.array([x[1] for x in queries], np.float64)
    metrics.check_dimensions(q[0], centroids.shape[1])
    near = np.argsort(block_distances(metric, centroids, q), axis=1, kind="stable")[:, : max(0, probes)]
    askers = {c: np.flatnonzero((near == c).any(axis=1)) for c in np.unique(near).tolist()}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, which, x = batch.column(0).to_numpy(), batch.column(1).to_numpy(), matrix(batch.column(2), q.shape[1])
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for c in np.unique(which).tolist():
                rows, who = np.flatnonzero(which == c), askers.get(c)
                if who is None:
                    continue
                d = block_distances(metric, x[rows], q[who])
                order = np.lexsort((np.broadcast_to(ids[rows], d.shape), d), axis=1)[:, :k]
                out.append((np.repeat(names[who], order.shape[1]), ids[rows][order].ravel(), np.take_along_axis(d, order, 1).ravel()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[i] for o in out])) for i in range(3)], ["qid", "id", "d"])

    probed = lists.where(F.col("list_id").isin(list(askers)))
    return _per_query(probed.select(F.col("id").cast("long"), "list_id", "vec").mapInArrow(run, "qid long, id long, d double"), metric, k)


def ivf_search_frame(lists: DataFrame, centroids: np.ndarray, queries: DataFrame, k: int, probes: int = PROBES, metric: str = "l2") -> DataFrame:
    """The same for every row of queries (qid, qvec), gathered in blocks of BLOCK_VALUES values."""
    out = in_blocks(queries, centroids.shape[1], lambda held: ivf_search_batch(lists, centroids, held, k, probes, metric))
    return out if out is not None else lists.sparkSession.createDataFrame([], "qid long, id long, distance double, rank int")


def write_lists(lists: DataFrame, path: str) -> None:
    """One folder for each list, so that a search reads the probed ones only."""
    lists.repartition("list_id").sortWithinPartitions("list_id").write.partitionBy("list_id").parquet(path)


# Product quantisation. A codebook is an array (subspaces, codes, dimensions of a subspace).


def pq_train(df: DataFrame, m: int = SUBSPACES, codes: int = CODES, passes: int = PQ_PASSES, id: str = "id", vec: str = "vec", seed: int = 42) -> np.ndarray:
    """Per-subspace k-means; with fewer rows than codes, as many codes as rows."""
    start = seeds(df, codes, id, vec, seed)
    return pq_train_from(df, start, m, passes, vec)


def pq_train_from(df: DataFrame, start: np.ndarray, m: int, passes: int, vec: str = "vec") -> np.ndarray:
    dims = start.shape[1] if len(start) else 0
    if not dims or dims % m:
        raise InvalidConfig("the dimensions must be a multiple of the number of subspaces")
    width = dims // m
    book = start.reshape(len(start), m, width).transpose(1, 0, 2).copy()
    for _ in range(passes):

        def run(batches: Iterable[pa.RecordBatch], book: np.ndarray = book) -> Iterator[pa.RecordBatch]:
            total, count = np.zeros(book.shape), np.zeros(book.shape[:2], np.int64)
            for batch in batches:
                x = matrix(batch.column(0), dims)
                for s in range(m):
                    part = x[:, s * width : (s + 1) * width]
                    near = block_distances("l2", part, book[s]).argmin(axis=0)
                    np.add.at(total[s], near, part)
                    count[s] += np.bincount(near, minlength=book.shape[1])
            s, c, d = (x.ravel().astype(np.int32) for x in np.indices(book.shape))
            yield pa.RecordBatch.from_arrays([pa.array(s), pa.array(c), pa.array(d), pa.array(total.ravel()), pa.array(np.repeat(count.ravel(), width))], ["s", "c", "d", "t", "n"])

        then = book.copy()
        for r in df.select(vec).mapInArrow(run, "s int, c int, d int, t double, n long").groupBy("s", "c", "d").agg(F.sum("t").alias("t"), F.sum("n").alias("n")).where("n > 0").collect():
            then[r.s, r.c, r.d] = r.t / r.n
        if np.array_equal(then, book):
            break
        book = then
    return book


def pq_encode(df: DataFrame, book: np.ndarray, id: str = "id", vec: str = "vec", keep: Sequence[str] = ()) -> DataFrame:
    """id, codes (binary, one byte a subspace), and keep."""
    m, n, width = book.shape
    if n > 256:
        raise InvalidConfig("at most 256 codes a subspace")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(1), m * width)
            near = np.stack([block_distances("l2", x[:, s * width : (s + 1) * width], book[s]).argmin(axis=0) for s in range(m)], axis=1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in near], pa.binary()), *batch.columns[2:]], ["id", "codes", *keep])

    kinds = "".join(f", {c} {df.schema[c].dataType.simpleString()}" for c in keep)
    return df.select(F.col(id).cast("long").alias("id"), F.col(vec), *keep).mapInArrow(run, "id long, codes binary" + kinds)


def pq_decode(df: DataFrame, book: np.ndarray) -> DataFrame:
    """id, vec: the centroids that the codes stand for."""
    m = book.shape[0]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, m)
            vec = np.concatenate([book[s][codes[:, s]] for s in range(m)], axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(vec), pa.list_(pa.float64()))], ["id", "vec"])

    return df.select("id", "codes").mapInArrow(run, "id long, vec array<double>")


def ivfpq_decode(df: DataFrame, centroids: np.ndarray, book: np.ndarray) -> DataFrame:
    """id, list_id, vec: the list's centroid plus what the codes of the residual stand for."""
    m = book.shape[0]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(-1, m)
            vec = centroids[batch.column(1).to_numpy()] + np.concatenate([book[s][codes[:, s]] for s in range(m)], axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(vec), pa.list_(pa.float64()))], ["id", "list_id", "vec"])

    return df.select("id", "list_id", "codes").mapInArrow(run, "id long, list_id int, vec array<double>")


def adc_table(book: np.ndarray, query: Sequence[float]) -> np.ndarray:
    """Squared distances of the query's parts to each code."""
    q = np.asarray(query, np.float64).reshape(book.shape[0], 1, book.shape[2])
    return ((book - q) ** 2).sum(axis=2)


def _adc(df: DataFrame, tables: dict[int | None, np.ndarray], keep: Sequence[str] = ()) -> DataFrame:
    m = next(iter(tables.values())).shape[0] if tables else 0
    by_list = None not in tables

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, m)
            out, which = np.zeros(len(codes)), batch.column(2).to_numpy() if by_list else None
            for name, table in tables.items():
                rows = np.flatnonzero(which == name) if by_list else slice(None)
                out[rows] = table[np.arange(m), codes[rows]].sum(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out), *batch.columns[2 + by_list :]], ["id", "__d", *keep])

    kinds = "".join(f", {c} {df.schema[c].dataType.simpleString()}" for c in keep)
    return df.select("id", "codes", *(["list_id"] if by_list else []), *keep).mapInArrow(run, "id long, __d double" + kinds)


def pq_search(df: DataFrame, book: np.ndarray, query: Sequence[float], k: int) -> DataFrame:
    """id, distance: squared distances by table lookup over codes."""
    return _rank(_adc(df, {None: adc_table(book, query)}), "dot_product", k, ())


def ivfpq_encode(df: DataFrame, centroids: np.ndarray, book: np.ndarray, metric: str = "l2", id: str = "id", vec: str = "vec", keep: Sequence[str] = ()) -> DataFrame:
    """id, codes of the residuals (vector minus its list's centroid), list_id, and keep."""
    return pq_encode(residuals(df, centroids, metric, id, vec, keep), book, keep=["list_id", *keep])


def residuals(df: DataFrame, centroids: np.ndarray, metric: str = "l2", id: str = "id", vec: str = "vec", keep: Sequence[str] = ()) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(2), centroids.shape[1]) - centroids[batch.column(1).to_numpy()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(x), pa.list_(pa.float64())), *batch.columns[3:]], ["id", "list_id", "vec", *keep])

    kinds = "".join(f", {c} {df.schema[c].dataType.simpleString()}" for c in keep)
    return assign(df, centroids, metric, id, vec, keep).mapInArrow(run, "id long, list_id int, vec array<double>" + kinds)


def ivfpq_search(codes: DataFrame, centroids: np.ndarray, book: np.ndarray, query: Sequence[float], k: int, probes: int = PROBES, metric: str = "l2", keep: Sequence[str] = ()) -> DataFrame:
    """id, distance: squared distances by lookup in the probed lists, whatever the metric (which ranks the lists)."""
    metrics.check_dimensions(query, centroids.shape[1])
    lists = probed_lists(centroids, query, probes, metric)
    tables = {c: adc_table(book, np.asarray(query, np.float64) - centroids[c]) for c in lists}
    return _rank(_adc(codes.where(F.col("list_id").isin(lists)), tables, keep), "dot_product", k, keep)
