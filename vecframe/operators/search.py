"""Exact nearest neighbours: one query, batches of queries, filters, quantised scans and reranking.

Ties go to the smaller id; NaN distances come last. One query is a projection and a top-k (TakeOrderedAndProject). A
batch is a matrix product over Arrow batches that keeps k rows a query and task, then one row_number per query whose
partial step keeps k rows before the shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..errors import DimensionMismatch
from ..functions import metrics, quantize
from ..sources.scratch import folder

OVERSCAN = 10
#: Query values (queries x dimensions) that go to the tasks at once; more queries take more passes.
BLOCK_VALUES = 4_000_000
#: Rows of queries for which Column expressions are used.
FEW = 1_000
#: Distances in a group of which the least is looked at first; queries of a product in single precision.
GROUP, AT_ONCE = 64, 128


def _rank(scored: DataFrame, metric: str, k: int, keep: Sequence[str]) -> DataFrame:
    top = scored.orderBy(F.col("__d").asc_nulls_last(), F.col("id")).limit(max(0, k))
    return top.select("id", metrics.true_distance(metric, F.col("__d")).alias("distance"), *keep)


def knn(df: DataFrame, query: Sequence[float], k: int, metric: str = "l2", id: str = "id", vec: str = "vec", keep: Sequence[str] = (), where: Column | None = None, mode: str = "exact") -> DataFrame:
    """id, distance and the columns of keep, nearest first.

    where restricts the candidates. mode "exact" filters first, so all k come if there are k; "overscan" takes the
    nearest OVERSCAN * k, filters them and keeps k, so it may return fewer.
    """
    rows = df.select(F.col(id).alias("id"), F.col(vec).alias("__v"), *keep, *([where.alias("__w")] if where is not None else []))
    scored = rows.withColumn("__d", metrics.query_distance(metric, F.col("__v"), query))
    if where is None:
        return _rank(scored.drop("__v"), metric, k, keep)
    if mode == "overscan":
        near = scored.orderBy(F.col("__d").asc_nulls_last(), F.col("id")).limit(OVERSCAN * k)
        return _rank(near.where("__w"), metric, k, keep)
    return _rank(scored.where("__w"), metric, k, keep)


def knn_batch_columns(df: DataFrame, queries: DataFrame, k: int, metric: str = "l2", id: str = "id", vec: str = "vec", qid: str = "qid", qvec: str = "qvec") -> DataFrame:
    """qid, id, distance, rank by Column expressions: for up to FEW queries, and by matrix products beyond."""
    if queries.limit(FEW + 1).count() > FEW:
        return knn_batch(df, queries, k, metric, id, vec, qid, qvec)
    pairs = df.select(F.col(id).alias("id"), F.col(vec).alias("v")).crossJoin(F.broadcast(queries.select(F.col(qid).alias("qid"), F.col(qvec).alias("q"))))
    scored = pairs.select("qid", "id", metrics.ordering_distance(metric, F.col("v"), F.col("q")).alias("d"))
    return _per_query(scored, metric, k)


def _per_query(scored: DataFrame, metric: str, k: int) -> DataFrame:
    order = Window.partitionBy("qid").orderBy(F.col("d").asc_nulls_last(), F.col("id"))
    top = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return top.select("qid", "id", metrics.true_distance(metric, F.col("d")).alias("distance"), "rank")


def block_distances(metric: str, rows: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Ordering distances of every query (rows of the result) to every row."""
    product = queries @ rows.T
    if metric == "dot_product":
        return -product
    r, q = np.einsum("ij,ij->i", rows, rows), np.einsum("ij,ij->i", queries, queries)
    if metric == "l2":
        return np.maximum(q[:, None] + r[None, :] - 2 * product, 0)
    size = np.sqrt(q)[:, None] * np.sqrt(r)[None, :]
    return np.where(size == 0, 1.0, 1 - product / np.where(size == 0, 1, size))


def matrix(column: pa.Array | pa.ChunkedArray, dims: int | None = None) -> np.ndarray:
    """An Arrow list column of equal sizes as a matrix of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    width = dims if dims is not None else (len(flat) // len(column) if len(column) else 0)
    if len(flat) != width * len(column):
        raise DimensionMismatch(f"vectors don't all have {width} dimensions")
    return flat.reshape(len(column), width)


def knn_batch(df: DataFrame, queries: DataFrame, k: int, metric: str = "l2", id: str = "id", vec: str = "vec", qid: str = "qid", qvec: str = "qvec") -> DataFrame:
    """qid, id, distance, rank for each query, by matrix products.

    Queries are gathered in blocks of BLOCK_VALUES values; a block is scanned for at once, so the memory of a task is
    bounded whatever the number of queries.
    """
    metrics.check_metric(metric)
    found = queries.select(F.col(qid).alias("qid"), F.col(qvec).alias("qvec"))
    first = found.first()
    if first is None or k <= 0:
        return df.sparkSession.createDataFrame([], "qid long, id long, distance double, rank int")
    dims = len(first.qvec)
    step = max(1, BLOCK_VALUES // max(1, dims))
    block = found.limit(step + 1).toArrow()
    if block.num_rows <= step:  # all of them
        names, q = block.column("qid").to_numpy().astype(np.int64), matrix(block.column("qvec"), dims)
        if len(names) >= k:
            rows = df.select(F.col(id).cast("long").alias("id"), F.col(vec).alias("vec")).limit(step + 1).toArrow()
            if 0 < rows.num_rows <= step:
                return _small(df.sparkSession, rows, names, q, k, metric)
        return _per_query(_block(df, names, q, k, metric, id, vec), metric, k)

    def run(held: list[tuple]) -> DataFrame:
        return _per_query(_block(df, np.array([h[0] for h in held], np.int64), np.array([h[1] for h in held], np.float64), k, metric, id, vec), metric, k)

    return in_blocks(found, dims, run)


def _small(spark: SparkSession, rows: pa.Table, names: np.ndarray, q: np.ndarray, k: int, metric: str) -> DataFrame:
    """The same where all rows are BLOCK_VALUES values at the most: they go to the tasks, among which queries are dealt."""
    ids, x = rows.column("id").to_numpy(), matrix(rows.column("vec"), q.shape[1])
    many = max(1, min(spark.sparkContext.defaultParallelism, len(q) * len(ids) // BLOCK_VALUES))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mine = batch.column(0).to_numpy()
            step = max(1, BLOCK_VALUES // len(ids))
            for at in range(0, len(mine), step):
                own = mine[at : at + step]
                i, near, d = closest(metric, x, ids, q[own], k)
                ranks = pa.array((np.arange(len(i)) - np.searchsorted(i, i) + 1).astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(names[own][i]), pa.array(near), pa.array(d), ranks], ["qid", "id", "d", "rank"])

    found = spark.range(0, len(q), 1, many).mapInArrow(run, "qid long, id long, d double, rank int")
    return found.select("qid", "id", metrics.true_distance(metric, F.col("d")).alias("distance"), "rank")


def least(i: np.ndarray, ids: np.ndarray, d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each query i the k least by d and id, in this order; NaN last."""
    order = np.lexsort((ids, np.where(np.isnan(d), np.inf, d), i))
    order = order[np.arange(len(i)) - np.searchsorted(i[order], i[order]) < k]
    return i[order], ids[order], d[order]


def closest(metric: str, x: np.ndarray, ids: np.ndarray, q: np.ndarray, k: int, bound: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of queries, ids and ordering distances of the k nearest rows of each query, in order (fewer if the rest is beyond its bound).

    A product's last bits depend on a row's place in the matrix, so it only tells which rows may be among the k; these
    are computed one by one. Copies thus have equal distances, and the smaller id comes first.
    """
    if not len(ids) or not len(q) or k <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    d = block_distances(metric, x, q)
    d[np.isnan(d)] = np.inf
    r, own = np.einsum("ij,ij->i", x, x), np.einsum("ij,ij->i", q, q)
    slack = 1e-12 * (np.ones(len(q)) if metric == "cosine" else own + r[np.isfinite(r)].max(initial=0))
    last = np.partition(d, k - 1, axis=1)[:, k - 1] if len(ids) > k else np.full(len(q), np.inf)
    last = last if bound is None else np.minimum(last, bound)
    i, j = np.nonzero(d <= (last + np.nan_to_num(slack, nan=0, posinf=0))[:, None])
    return least(i, ids[j], _each(metric, x, q, i, j), k)


def _each(metric: str, x: np.ndarray, q: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Ordering distances of queries i to rows j, one by one."""
    e = np.zeros(len(i))
    for at in range(0, len(i), 20_000):
        some = slice(at, at + 20_000)
        a, b = x[j[some]], q[i[some]]
        if metric == "l2":
            e[some] = np.square(a - b).sum(axis=1)
        else:
            e[some] = (a * b).sum(axis=1)
            if metric == "dot_product":
                e[some] *= -1
            else:
                size = np.sqrt(np.square(a).sum(axis=1)) * np.sqrt(np.square(b).sum(axis=1))
                e[some] = np.where(size == 0, 1.0, 1 - e[some] / np.where(size == 0, 1, size))
    return e


def closest_of_many(metric: str, x: np.ndarray, ids: np.ndarray, q: np.ndarray, k: int, bound: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """closest() where rows and queries are many: one product in single precision, whose errors are bounded, tells which may be among the k.

    Every m-th row makes a group. The k-th least of the groups' minima is no less than the k-th distance, so only groups
    that begin below it are looked at.
    """
    n, many = len(ids), len(ids) // GROUP
    r, own = np.einsum("ij,ij->i", x, x), np.einsum("ij,ij->i", q, q)
    widest = np.square(np.sqrt(r.max(initial=0)) + np.sqrt(own))  # NaN if any value is
    if k <= 0 or many <= 2 * k or not (widest < 1e30).all():
        step = max(1, BLOCK_VALUES // max(1, n))
        bound = np.full(len(q), np.inf) if bound is None else bound
        found = [(at + i, near, d) for at in range(0, len(q), step) for i, near, d in [closest(metric, x, ids, q[at : at + step], k, bound[at : at + step])]]
        return tuple(np.concatenate(f) for f in zip(*found, strict=True)) if found else closest(metric, x, ids, q, k)
    slack = 2 * (x.shape[1] + 8) * 2.0**-23 * (np.ones(len(q)) if metric == "cosine" else widest) + 1e-30
    if bound is not None:  # as the product has it
        bound = bound - {"l2": own, "cosine": 1}.get(metric, 0)
    if metric == "l2":
        rows, asked = np.hstack([x, r[:, None]]), np.hstack([-2 * q, np.ones((len(q), 1))])
    elif metric == "cosine":
        rows, asked = (v / np.sqrt(np.where(size == 0, 1, size))[:, None] for v, size in ((x, r), (-q, own)))
    else:
        rows, asked = x, -q
    rows, asked, out = rows.astype(np.float32), asked.astype(np.float32), []
    held = np.empty((min(len(q), AT_ONCE), n), np.float32)
    for at in range(0, len(q), AT_ONCE):
        part = slice(at, at + AT_ONCE)
        d = np.matmul(asked[part], rows.T, out=held[: len(q[part])])
        low = d[:, : many * GROUP].reshape(len(d), GROUP, many).min(axis=1)
        last = np.partition(low, k - 1, axis=1)[:, k - 1]
        last = ((last if bound is None else np.minimum(last, bound[part])) + slack[part])[:, None]
        i, group = np.divmod(np.flatnonzero(low <= last), many)
        j = group[:, None] + many * np.arange(GROUP)
        near = d[i[:, None], j] <= last[i]
        i, j = np.repeat(i, near.sum(axis=1)), j[near]
        others = np.nonzero(d[:, many * GROUP :] <= last)
        i, j = np.concatenate([i, others[0]]), np.concatenate([j, many * GROUP + others[1]])
        i, near, e = least(i, ids[j], _each(metric, x, q[part], i, j), k)
        out.append((at + i, near, e))
    return tuple(np.concatenate(f) for f in zip(*out, strict=True))


def bounds(found: tuple[np.ndarray, np.ndarray, np.ndarray], many: int, k: int) -> np.ndarray:
    """Of each of many queries the k-th distance of found, as least gives it; infinite where there are fewer."""
    out = np.full(many, np.inf)
    full = np.flatnonzero(np.bincount(found[0], minlength=many) == k)
    last = found[2][np.searchsorted(found[0], full, side="right") - 1]
    out[full] = np.where(np.isnan(last), np.inf, last)
    return out


def merged(found: DataFrame, metric: str, k: int) -> DataFrame:
    """qid, id, distance, rank of the k nearest in found: qid and arrays of ids and ordering distances, several rows a query."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, more = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)), []
        for batch in batches:
            counts = batch.column(1).value_lengths().to_numpy()
            more.append((np.repeat(batch.column(0).to_numpy(), counts), batch.column(1).flatten().to_numpy(), batch.column(2).flatten().to_numpy()))
            if sum(len(x[0]) for x in more) > 500_000:
                held, more = least(*[np.concatenate(x) for x in zip(held, *more, strict=True)], k), []
        held = least(*[np.concatenate(x) for x in zip(held, *more, strict=True)], k)
        ranks = (np.arange(len(held[0])) - np.searchsorted(held[0], held[0]) + 1).astype(np.int32)
        for at in range(0, len(ranks), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[at : at + 10_000]) for x in (*held, ranks)], ["qid", "id", "d", "rank"])

    top = found.repartition("qid").mapInArrow(run, "qid long, id long, d double, rank int")
    return top.select("qid", "id", metrics.true_distance(metric, F.col("d")).alias("distance"), "rank")


def _block(df: DataFrame, names: np.ndarray, q: np.ndarray, k: int, metric: str, id: str, vec: str) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, bound = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)), np.full(len(q), np.inf)
        step = max(1, BLOCK_VALUES // len(q))  # distances held at once
        for batch in (b.slice(at, step) for b in batches for at in range(0, b.num_rows, step)):
            new = closest(metric, matrix(batch.column(1), q.shape[1]), batch.column(0).to_numpy(), q, k, bound)
            if len(new[0]):
                held = least(*[np.concatenate(x) for x in zip(held, new, strict=True)], k)
                bound = bounds(held, len(q), k)
        for at in range(0, len(held[0]), 10_000):
            i, ids, d = (x[at : at + 10_000] for x in held)
            yield pa.RecordBatch.from_arrays([pa.array(names[i], pa.int64()), pa.array(ids, pa.int64()), pa.array(d)], ["qid", "id", "d"])

    return df.select(F.col(id).cast("long"), F.col(vec)).mapInArrow(run, "qid long, id long, d double")


def knn_int8(df: DataFrame, query: Sequence[float], k: int, metric: str = "l2", id: str = "id", vec: str = "vec", keep: Sequence[str] = ()) -> DataFrame:
    """Over decoded 8-bit codes, with the query as it is."""
    codes = df.select(F.col(id).alias("id"), quantize.int8_encode(F.col(vec)).alias("c"), quantize.int8_scale(F.col(vec)).alias("s"), *keep)
    return knn(codes.select("id", quantize.int8_decode(F.col("c"), F.col("s")).alias("vec"), *keep), query, k, metric, keep=keep)


def knn_fp16(df: DataFrame, query: Sequence[float], k: int, metric: str = "l2", id: str = "id", vec: str = "vec", keep: Sequence[str] = ()) -> DataFrame:
    return knn(df.select(F.col(id).alias("id"), quantize.fp16_round(F.col(vec)).alias("vec"), *keep), query, k, metric, keep=keep)


def knn_binary(df: DataFrame, query: Sequence[float], k: int, metric: str = "l2", id: str = "id", vec: str = "vec", keep: Sequence[str] = ()) -> DataFrame:
    """By sign bits."""
    bits, size = quantize.binary_columns(F.col(vec))
    q_bits, q_size = quantize.binary_columns(metrics.vector(query))
    differing = metrics.hamming(F.col("__b"), q_bits)
    rows = df.select(F.col(id).alias("id"), bits.alias("__b"), size.alias("__n"), *keep)
    found = rows.withColumn("distance", metrics.binary_distance(metric, differing, len(query), F.col("__n"), q_size))
    return found.select("id", "distance", *keep).orderBy("distance", "id").limit(max(0, k))


def rerank(candidates: DataFrame, df: DataFrame, query: Sequence[float], k: int, metric: str = "l2", id: str = "id", vec: str = "vec") -> DataFrame:
    """The exact nearest of candidates (column id), which are broadcast if Spark finds them small."""
    return knn(df.join(candidates.select(F.col("id").alias(id)), id, "left_semi"), query, k, metric, id, vec)


def in_blocks(queries: DataFrame, dims: int, run: Callable[[list[tuple]], DataFrame]) -> DataFrame | None:
    """The union of run over blocks of BLOCK_VALUES values of (qid, qvec); None without queries.

    A single block is left to the caller's plan. Of several, each one's result is written before the next is read, so
    the driver holds one block and the plan doesn't grow.
    """
    found, size, path = queries.select("qid", "qvec"), max(1, BLOCK_VALUES // dims), None
    block = found.limit(size + 1).toArrow()
    if block.num_rows <= size:  # all of them
        return run(list(zip(block.column("qid").to_pylist(), matrix(block.column("qvec"), dims), strict=True))) if block.num_rows else None
    rows = found.toLocalIterator()
    held = [(r.qid, r.qvec) for r in islice(rows, size)]
    while more := [(r.qid, r.qvec) for r in islice(rows, size)]:
        part = run(held)
        path = path or folder(queries.sparkSession)
        part.write.mode("append").parquet(path)
        held = more
    part = run(held)
    if path is None:
        return part
    part.write.mode("append").parquet(path)
    return queries.sparkSession.read.schema(part.schema).parquet(path)


def pair_stats(df: DataFrame, queries: DataFrame) -> DataFrame:
    """qid, least, most, mean of each query's (qid, qvec) distances (l2) to all rows (id, vec): one row a query and task moves."""
    first = queries.first()

    def block(held: list[tuple]) -> DataFrame:
        names, q = np.array([h[0] for h in held], np.int64), np.array([h[1] for h in held], np.float64)

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            least, most, total, n = np.full(len(q), np.inf), np.full(len(q), -np.inf), np.zeros(len(q)), 0
            for batch in batches:
                x = matrix(batch.column(0), q.shape[1])
                n += len(x)
                step = max(1, BLOCK_VALUES // max(1, len(x)))
                for at in range(0, len(q) if len(x) else 0, step):
                    part = slice(at, at + step)
                    d = block_distances("l2", x, q[part])
                    # What nearly cancels is computed from the differences.
                    i, j = np.nonzero(d <= 1e-6 * np.einsum("ij,ij->i", q[part], q[part])[:, None])
                    for a in range(0, len(i), 10_000):
                        b = slice(a, a + 10_000)
                        d[i[b], j[b]] = ((q[part][i[b]] - x[j[b]]) ** 2).sum(axis=1)
                    d = np.sqrt(d)
                    least[part] = np.minimum(least[part], d.min(axis=1))
                    most[part] = np.maximum(most[part], d.max(axis=1))
                    total[part] += d.sum(axis=1)
            if n:
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(least), pa.array(most), pa.array(total), pa.array(np.full(len(q), n))], ["qid", "a", "b", "s", "n"])

        return df.select("vec").mapInArrow(run, "qid long, a double, b double, s double, n long")

    parts = None if first is None else in_blocks(queries, len(first.qvec), block)
    if parts is None:
        return df.sparkSession.createDataFrame([], "qid long, least double, most double, mean double")
    return parts.groupBy("qid").agg(F.min("a").alias("least"), F.max("b").alias("most"), (F.sum("s") / F.sum("n")).alias("mean"))


def rerank_batch(candidates: DataFrame, df: DataFrame, queries: DataFrame, k: int, metric: str = "l2") -> DataFrame:
    """qid, id, distance, rank: the exact nearest of each query's candidates (qid, id); df (id, vec), queries (qid, qvec)."""
    pairs = candidates.select("qid", "id").join(df.select("id", "vec"), "id").join(queries.select("qid", "qvec"), "qid")
    return _per_query(pairs.select("qid", "id", metrics.ordering_distance(metric, F.col("vec"), F.col("qvec")).alias("d")), metric, k)


def recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """qid, recall: the share of truth's (qid, id) that found has."""
    hit = truth.select("qid", "id").join(found.select("qid", "id", F.lit(1).alias("hit")), ["qid", "id"], "left")
    return hit.groupBy("qid").agg((F.count("hit") / F.count("*")).alias("recall"))
