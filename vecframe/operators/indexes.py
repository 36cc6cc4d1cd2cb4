"""Index classes over a DataFrame of vectors, by index type.

Rows are added one at a time, in batches, from a matrix, or as a DataFrame; the latest row of an id counts (flat and
hnsw refuse known ids instead). What a type derives (codes, lists, graphs) is built from the raw rows, which stay.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import errors
from ..functions import metrics
from . import cluster, hnsw, keyword, search


class FlatIndex:
    kind, strict = "flat", True

    def __init__(self, spark: SparkSession, dimensions: int, metric: str = "l2", **options: int):
        if dimensions < 1:
            raise errors.InvalidConfig("at least one dimension is needed")
        self.spark, self.dimensions, self.metric, self.options = spark, dimensions, metrics.check_metric(metric), options
        self._frames: list[DataFrame] = []
        self._pending: list[tuple[int, list[float]]] = []
        self._seq, self._built = 0, None

    def __repr__(self) -> str:
        return f"{type(self).__name__}(dimensions={self.dimensions}, metric={self.metric!r})"

    def __len__(self) -> int:
        return self.rows().count()

    def _frame(self, df: DataFrame, gone: bool = False) -> None:
        self._seq += 1
        self._built = None
        self._frames.append(df.select(F.lit(self._seq).alias("seq"), F.col("n").cast("long").alias("n"), F.col("id").cast("long").alias("id"), F.col("vec").cast("array<float>").alias("vec"), F.lit(gone).alias("gone")))

    def _flush_pending(self) -> None:
        if self._pending:
            rows = [(n, i, v) for n, (i, v) in enumerate(self._pending)]
            self._pending = []
            self._frame(self.spark.createDataFrame(rows, "n long, id long, vec array<float>"))

    def rows(self, among: DataFrame | None = None) -> DataFrame:
        """id, vec of the live rows; among: of these ids only, which are looked for before anything is combined."""
        self._flush_pending()
        if not self._frames:
            return self.spark.createDataFrame([], "id long, vec array<float>")
        every = self._frames[0]
        for x in self._frames[1:]:
            every = every.unionByName(x)
        if among is not None:
            every = every.join(among.select("id"), "id", "left_semi")
        last = every.groupBy("id").agg(F.max_by(F.struct("vec", "gone"), F.struct("seq", "n")).alias("x"))
        return last.where("not x.gone").select("id", F.col("x.vec").alias("vec"))

    def _check_new(self, ids: Sequence[int]) -> None:
        if min(ids, default=0) < 0:
            raise errors.InvalidConfig("ids aren't negative")
        if self.strict:
            known = {i for i, _ in self._pending} & set(ids)
            if not known and self._frames:
                asked = self.spark.createDataFrame([(i,) for i in ids], "id long")
                known = {r.id for r in self.rows(asked).limit(1).collect()}
            if known or len(set(ids)) < len(ids):
                raise errors.DuplicateId(next(iter(known), ids[0]))

    def add(self, id: int, vector: Sequence[float]) -> None:
        self.add_batch([(id, vector)])

    def add_batch(self, entries: Sequence[tuple[int, Sequence[float]]]) -> None:
        """All entries are checked before the first is added."""
        for _, v in entries:
            metrics.check_dimensions(v, self.dimensions)
        self._check_new([i for i, _ in entries])
        self._pending += [(int(i), [float(x) for x in v]) for i, v in entries]
        self._built = None

    def add_batch_np(self, vectors: np.ndarray, start_id: int = 0) -> None:
        """Rows of a matrix, with ids from start_id on."""
        x = np.asarray(vectors, np.float32)
        if x.ndim != 2 or x.shape[1] != self.dimensions:
            raise errors.DimensionMismatch(f"expected a matrix of {self.dimensions} columns")
        self._flush_pending()
        ids = np.arange(start_id, start_id + len(x), dtype=np.int64)
        vec = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), self.dimensions).cast(pa.list_(pa.float32()))
        self._frame(self.spark.createDataFrame(pa.table({"n": ids, "id": ids, "vec": vec})))

    def add_frame(self, df: DataFrame) -> None:
        """From columns id and vec."""
        self._flush_pending()
        self._frame(df.select(F.lit(0).alias("n"), "id", "vec"))

    def delete(self, id: int) -> bool:
        if self.rows(self.spark.createDataFrame([(id,)], "id long")).isEmpty():
            return False
        self._frame(self.spark.createDataFrame([(0, id, None)], "n long, id long, vec array<float>"), gone=True)
        return True

    def flush(self) -> None:
        self._flush_pending()

    def search_frame(self, query: Sequence[float], k: int) -> DataFrame:
        metrics.check_dimensions(query, self.dimensions)
        return search.knn(self.rows(), query, k, self.metric)

    def search(self, query: Sequence[float], k: int) -> list[dict]:
        return [{"id": r.id, "distance": r.distance} for r in self.search_frame(query, k).collect()] if k > 0 else []

    def search_batch(self, queries: DataFrame, k: int) -> DataFrame:
        """qid, id, distance, rank for queries (qid, qvec): exact."""
        return search.knn_batch(self.rows(), queries, k, self.metric)

    def __iter__(self) -> Iterator[tuple[int, list[float]]]:
        return ((r.id, r.vec) for r in self.rows().toLocalIterator())

    def save(self, path: str) -> None:
        about = json.dumps({"kind": self.kind, "dimensions": self.dimensions, "metric": self.metric, "options": self.options})
        self.rows().write.mode("overwrite").parquet(f"{path}/rows")
        self.spark.createDataFrame([(about,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/about")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> FlatIndex:
        about = json.loads(spark.read.text(f"{path}/about").first().value)
        made = BY_KIND[about["kind"]](spark, about["dimensions"], about["metric"], **about["options"])
        made.add_frame(spark.read.parquet(f"{path}/rows"))
        return made


class MmapFlatIndex(FlatIndex):
    """Exact search over Parquet; nothing stays in memory between queries."""

    kind, strict = "mmap_flat", False

    def __init__(self, spark: SparkSession, dimensions: int, metric: str = "l2", path: str | None = None, **options: int):
        super().__init__(spark, dimensions, metric, **options)
        self.path = path

    def flush(self) -> None:
        """Write the live rows as a new version and read from there."""
        if self.path:
            version = f"{self.path}/v{self._seq + 1}"
            self.rows().write.mode("overwrite").parquet(version)
            self._frames = []
            self.add_frame(self.spark.read.parquet(version))


class QuantizedFlatIndex(FlatIndex):
    kind, strict = "quantized_flat", False

    def search_frame(self, query: Sequence[float], k: int) -> DataFrame:
        metrics.check_dimensions(query, self.dimensions)
        return search.knn_int8(self.rows(), query, k, self.metric)


class Fp16FlatIndex(FlatIndex):
    kind, strict = "fp16_flat", False

    def search_frame(self, query: Sequence[float], k: int) -> DataFrame:
        metrics.check_dimensions(query, self.dimensions)
        return search.knn_fp16(self.rows(), query, k, self.metric)


class BinaryFlatIndex(FlatIndex):
    kind, strict = "binary_flat", False

    def search_frame(self, query: Sequence[float], k: int) -> DataFrame:
        metrics.check_dimensions(query, self.dimensions)
        return search.knn_binary(self.rows(), query, k, self.metric)


class IvfIndex(FlatIndex):
    """Options: n_lists, nprobe, train_size (fewer rows are searched exactly), max_iter."""

    kind, strict = "ivf", False
    defaults = {"n_lists": cluster.LISTS, "nprobe": cluster.PROBES, "train_size": 4096, "max_iter": cluster.PASSES}

    def option(self, name: str) -> int:
        return self.options.get(name, self.defaults[name])

    def flush(self) -> None:
        """Train on the rows there are."""
        self._train()

    def _train(self) -> tuple:
        rows = self.rows()
        if self._built is None:
            centroids = cluster.kmeans(rows, self.option("n_lists"), self.metric, self.option("max_iter"))
            self._built = centroids, cluster.assign(rows, centroids, self.metric)
        return self._built

    def _trained(self) -> bool:
        return self._built is not None or len(self) >= self.option("train_size")

    def search_frame(self, query: Sequence[float], k: int) -> DataFrame:
        if not self._trained():
            return super().search_frame(query, k)
        centroids, lists = self._train()
        return cluster.ivf_search(lists, centroids, query, k, self.option("nprobe"), self.metric)


class IvfPqIndex(IvfIndex):
    """Options of IvfIndex, and pq_m, pq_k_sub."""

    kind = "ivf_pq"
    defaults = IvfIndex.defaults | {"pq_m": cluster.SUBSPACES, "pq_k_sub": cluster.CODES}

    def __init__(self, spark: SparkSession, dimensions: int, metric: str = "l2", **options: int):
        super().__init__(spark, dimensions, metric, **options)
        if dimensions % self.option("pq_m"):
            raise errors.InvalidConfig("the dimensions must be a multiple of pq_m")

    def _train(self) -> tuple:
        rows = self.rows()
        if self._built is None:
            centroids = cluster.kmeans(rows, self.option("n_lists"), self.metric, self.option("max_iter"))
            book = cluster.pq_train(cluster.residuals(rows, centroids, self.metric), self.option("pq_m"), self.option("pq_k_sub"))
            self._built = centroids, book, cluster.ivfpq_encode(rows, centroids, book, self.metric)
        return self._built

    def search_frame(self, query: Sequence[float], k: int) -> DataFrame:
        if not self._trained():
            return FlatIndex.search_frame(self, query, k)
        centroids, book, codes = self._train()
        return cluster.ivfpq_search(codes, centroids, book, query, k, self.option("nprobe"), self.metric)


class HnswIndex(FlatIndex):
    """Options: m, ef_construction, ef_search, shards."""

    kind = "hnsw"

    def add_batch_parallel(self, entries: Sequence[tuple[int, Sequence[float]]]) -> None:
        """As add_batch; shards are always built in parallel."""
        self.add_batch(entries)

    def flush(self) -> None:
        self._graph()

    def set_ef_search(self, n: int) -> None:
        self.options["ef_search"] = n

    def _graph(self) -> DataFrame:
        rows = self.rows()
        if self._built is None:
            o = self.options
            self._built = hnsw.build(rows, self.metric, o.get("m", hnsw.M), o.get("ef_construction", hnsw.EF_BUILD), o.get("shards")).persist()
        return self._built

    def search_frame(self, query: Sequence[float], k: int) -> DataFrame:
        metrics.check_dimensions(query, self.dimensions)
        return hnsw.search(self._graph(), [(0, query)], k, self.metric, self.options.get("ef_search", hnsw.EF_SEARCH)).select("id", "distance").orderBy("distance", "id")


BY_KIND = {c.kind: c for c in (FlatIndex, MmapFlatIndex, QuantizedFlatIndex, Fp16FlatIndex, BinaryFlatIndex, IvfIndex, IvfPqIndex, HnswIndex)}


def from_factory(spark: SparkSession, dimensions: int, factory: str, metric: str = "l2") -> FlatIndex:
    """The index that a factory string names: Flat, SQ8, SQfp16, HNSW<m>, IVF<lists>,Flat or IVF<lists>,PQ<m>[x<bits>]."""
    if factory in (plain := {"Flat": FlatIndex, "SQ8": QuantizedFlatIndex, "SQfp16": Fp16FlatIndex}):
        return plain[factory](spark, dimensions, metric)
    if found := re.fullmatch(r"HNSW(\d+)(,Flat)?", factory):
        return HnswIndex(spark, dimensions, metric, m=int(found[1]))
    if found := re.fullmatch(r"IVF(\d+),(Flat|PQ(\d+)(?:x(\d+))?)", factory):
        lists = int(found[1])
        if found[2] == "Flat":
            return IvfIndex(spark, dimensions, metric, n_lists=lists)
        bits = int(found[4] or 8)
        if bits > 8:
            raise errors.InvalidConfig("codes have 8 bits at most")
        return IvfPqIndex(spark, dimensions, metric, n_lists=lists, pq_m=int(found[3]), pq_k_sub=1 << bits)
    raise errors.InvalidConfig(f"unknown factory string {factory!r}")


class SparseIndex:
    """Sparse vectors by id, with dot-product search; an upsert replaces the id's vector."""

    def __init__(self, spark: SparkSession):
        self.spark, self._frames = spark, []

    def _change(self, rows: list[tuple[int, dict | None]]) -> None:
        changes = [(len(self._frames), n, i, None if v is None else {int(d): float(w) for d, w in v.items()}) for n, (i, v) in enumerate(rows)]
        self._frames.append(self.spark.createDataFrame(changes, "seq long, n long, id long, vec map<bigint,double>"))

    def upsert(self, id: int, vector: dict) -> None:
        self._change([(id, vector)])

    def upsert_batch(self, entries: Sequence[tuple[int, dict]]) -> None:
        self._change(list(entries))

    def rows(self) -> DataFrame:
        """id, vec (a map) of the vectors that are there."""
        if not self._frames:
            return self.spark.createDataFrame([], "id long, vec map<bigint,double>")
        every = self._frames[0]
        for x in self._frames[1:]:
            every = every.unionByName(x)
        last = every.groupBy("id").agg(F.max_by(F.struct("vec"), F.struct("seq", "n")).alias("x"))
        return last.select("id", F.col("x.vec").alias("vec")).where("vec is not null")

    def postings(self) -> DataFrame:
        return self.rows().select("id", F.explode("vec").alias("dim", "w"))

    def get(self, id: int) -> dict | None:
        found = self.rows().where(F.col("id") == id).first()
        return None if found is None else dict(found.vec)

    def __contains__(self, id: int) -> bool:
        return self.get(id) is not None

    def __len__(self) -> int:
        return self.rows().count()

    def __iter__(self) -> Iterator[tuple[int, dict]]:
        return ((r.id, dict(r.vec)) for r in self.rows().toLocalIterator())

    def delete(self, id: int) -> bool:
        if id not in self:
            return False
        self._change([(id, None)])
        return True

    def search(self, query: dict, k: int) -> list[dict]:
        return [{"id": r.id, "score": r.score} for r in keyword.sparse_top(self.postings(), query, k).collect()]
