"""Collections as Parquet change logs under a folder, with a manifest, compaction and snapshots.

A collection is a folder: ``meta.json``, ``log/<n>`` (Parquet batches of changes), ``manifest/<n>.json`` (the batches
that count, in order; the last complete one holds), ``index/<base>`` and ``snapshots/<name>.json`` (a manifest that
stays). A change is (seq, n, op, id, vec, payload, sparse); the latest one of an id wins, sparse values stay until they
are replaced or the id is deleted. A batch counts once a manifest names it, and a manifest is a new file that takes its
name when it is complete, so what a failed write leaves behind is ignored. Folders are reached through Hadoop's file
systems, so any store that Spark can write is possible. One writer at a time is assumed.

The manifest's base is a compacted batch: each live id once, sorted. Only changes after it are combined when rows are
read; the base's rows pass by, but for the ids that changed. Built indexes (lists, codes, graphs, and what was trained
for them) belong to a base and stay on disk with it. Later changes are searched exactly beside the index, with its
own rows of their ids left out, until they are more than a share of the base; then base and index are made anew.
"""

from __future__ import annotations

import json
import time
import uuid
import warnings
from collections.abc import Sequence
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .. import errors
from ..functions import metrics
from ..functions.filters import compile_filter
from ..operators import cluster, fusion, hnsw, search
from ..operators.keyword import sparse_top

#: Versions of a manifest that are kept.
VERSIONS = 3
INDEX_TYPES = ("flat", "hnsw", "quantized_flat", "ivf", "ivf_pq", "fp16_flat", "mmap_flat", "binary_flat")
COMPACTION = 50_000
#: Compact when there are as many changes as this share of the base's rows, and COMPACTION at least.
DEAD_SHARE = 0.5
#: Changes beside an index that are searched exactly: so many, or this share of the base.
STAGED, STAGED_SHARE = 1_000, 0.1
CHANGES = T.StructType([
    T.StructField("seq", T.LongType()), T.StructField("n", T.LongType()), T.StructField("op", T.StringType()), T.StructField("id", T.LongType()), T.StructField("vec", T.ArrayType(T.FloatType())),
    T.StructField("payload", T.StringType()), T.StructField("sparse", T.MapType(T.LongType(), T.DoubleType())),
])


#: What a manifest says of the rows, and a snapshot keeps.
STATE = ("base", "log", "rows", "changes")


def _batches(manifest: dict) -> list[str]:
    return [*([manifest["base"]] if manifest["base"] else []), *manifest["log"]]


class Files:
    """Small files and folders by Hadoop's file system."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self._path(root).getFileSystem(self.conf)

    def _path(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def read(self, path: str) -> str:
        stream = self.fs.open(self._path(path))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write(self, path: str, text: str) -> None:
        """A new file, complete as soon as it has its name."""
        folder, name = path.rsplit("/", 1)
        temporary = f"{folder}/.{name}.{uuid.uuid4().hex}"
        stream = self.fs.create(self._path(temporary), True)
        stream.write(bytearray(text.encode()))
        stream.close()
        if self.exists(path) or not self.fs.rename(self._path(temporary), self._path(path)):
            self.fs.delete(self._path(temporary), False)
            raise OSError(f"{path} can't be written")

    def versions(self, folder: str) -> list[int]:
        return sorted(int(x[:-5]) for x in self.names(folder) if x.endswith(".json") and x[:-5].isdigit())

    def read_last(self, folder: str) -> dict:
        """What the last complete version in the folder holds."""
        for n in reversed(self.versions(folder)):
            try:
                return json.loads(self.read(f"{folder}/{n:012d}.json"))
            except ValueError:
                continue
        raise FileNotFoundError(folder)

    def write_next(self, folder: str, content: dict) -> None:
        """As the next version; all but the last few are deleted."""
        known = self.versions(folder)
        self.write(f"{folder}/{(known[-1] if known else 0) + 1:012d}.json", json.dumps(content))
        for n in known[: -VERSIONS + 1]:
            self.delete(f"{folder}/{n:012d}.json")

    def exists(self, path: str) -> bool:
        return self.fs.exists(self._path(path))

    def delete(self, path: str) -> bool:
        return self.fs.delete(self._path(path), True)

    def names(self, path: str) -> list[str]:
        return sorted(x.getPath().getName() for x in self.fs.listStatus(self._path(path))) if self.exists(path) else []


def check_name(name: str) -> str:
    if not name or "/" in name or "\\" in name or ".." in name or name.startswith("."):
        raise errors.InvalidConfig(f"invalid name {name!r}")
    return name


class Collection:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.files = spark, path, Files(spark, path)
        self.meta = json.loads(self.files.read(f"{path}/meta.json"))
        self._index: tuple[Any, Any] | None = None  # (manifest version, whatever the index type keeps)
        self._embed: Any = None

    name = property(lambda self: self.meta["name"])
    dimensions = property(lambda self: self.meta["dimensions"])
    metric = property(lambda self: self.meta["metric"])
    index_type = property(lambda self: self.meta["index_type"])

    def __repr__(self) -> str:
        return f"Collection({self.name!r}, dimensions={self.dimensions}, metric={self.metric!r}, index_type={self.index_type!r})"

    # Writing.

    def _manifest(self) -> dict:
        return self.files.read_last(f"{self.path}/manifest")

    def _commit(self, manifest: dict, same: bool = False) -> None:
        """same: the rows are what they were."""
        self.files.write_next(f"{self.path}/manifest", manifest if same else manifest | {"version": uuid.uuid4().hex})

    def append(self, changes: DataFrame, batch: str | None = None) -> bool:
        """Add changes (op, id, vec, payload, sparse, and n: their order); a batch name that is known is not added again."""
        manifest = self._manifest()
        if batch is not None and batch in manifest["named"]:
            return False
        seq = manifest["seq"] + 1
        wrong = (F.col("op") != "delete") & (F.coalesce(F.size("vec"), F.lit(-1)) != self.dimensions)
        vec = F.when(wrong, F.raise_error(F.lit(f"expected {self.dimensions} dimensions")).cast("array<float>")).otherwise(F.col("vec"))
        rows = changes.withColumn("vec", vec).withColumn("seq", F.lit(seq).cast("long"))
        folder = f"log/{seq:012d}-{uuid.uuid4().hex[:8]}"
        rows.select(*[F.col(f.name).cast(f.dataType) for f in CHANGES]).write.parquet(f"{self.path}/{folder}")
        manifest["log"].append(folder)
        manifest["changes"] += self.spark.read.parquet(f"{self.path}/{folder}").count()  # from the files' footers
        manifest["seq"] = seq
        if batch is not None:
            manifest["named"].append(batch)
        self._commit(manifest)
        return True

    def _put(self, op: str, entries: Sequence[tuple]) -> None:
        rows = []
        for n, (id, vec, payload, sparse) in enumerate(entries):
            if vec is not None:
                metrics.check_dimensions(vec, self.dimensions)
            if id < 0:
                raise errors.InvalidConfig("ids aren't negative")
            text = None if payload is None else json.dumps(payload, ensure_ascii=False, default=str)
            rows.append((None, n, op, int(id), None if vec is None else [float(x) for x in vec], text, None if sparse is None else {int(d): float(w) for d, w in sparse.items()}))
        if rows:
            self.append(self.spark.createDataFrame(rows, CHANGES))
            self.maybe_compact()

    def upsert_hybrid_batch(self, entries: Sequence[tuple]) -> None:
        """(id, vector, sparse vector or None, payload or None)."""
        self._put("put", [(e[0], e[1], e[3] if len(e) > 3 else None, e[2] if len(e) > 2 else None) for e in entries])

    def upsert(self, id: int, vector: Sequence[float], payload: Any = None) -> None:
        self._put("put", [(id, vector, payload, None)])

    def upsert_batch(self, entries: Sequence[tuple]) -> None:
        """(id, vector) or (id, vector, payload); of the same id the last one counts."""
        self._put("put", [(e[0], e[1], e[2] if len(e) > 2 else None, None) for e in entries])

    def upsert_hybrid(self, id: int, vector: Sequence[float], sparse_vector: dict | None = None, payload: Any = None) -> None:
        self._put("put", [(id, vector, payload, sparse_vector)])

    def upsert_frame(self, df: DataFrame, batch: str | None = None) -> bool:
        """From columns id, vec and, if there, payload (JSON text), sparse (map) and n (order within the batch)."""
        have = set(df.columns)
        rows = df.select(
            F.lit("put").alias("op"), "id", "vec", (F.col("payload") if "payload" in have else F.lit(None)).alias("payload"),
            (F.col("sparse") if "sparse" in have else F.lit(None)).alias("sparse"), (F.col("n") if "n" in have else F.lit(0)).alias("n"),
        )
        return self._appended(rows, batch)

    def _appended(self, rows: DataFrame, batch: str | None) -> bool:
        added = self.append(rows, batch)
        if added:
            self.maybe_compact()
        return added

    def delete(self, id: int) -> bool:
        """Whether the id was there."""
        return self.delete_batch([id]) > 0

    def delete_batch(self, ids: Sequence[int]) -> int:
        """How many of the ids were there; they go in one batch."""
        there = sorted(r.id for r in self.rows().select("id").where(F.col("id").isin([int(i) for i in ids])).collect())
        self._put("delete", [(i, None, None, None) for i in there])
        return len(there)

    def delete_frame(self, ids: DataFrame, batch: str | None = None) -> bool:
        return self._appended(ids.select(F.lit("delete").alias("op"), "id", F.lit(None).alias("vec"), F.lit(None).alias("payload"), F.lit(None).alias("sparse"), F.lit(0).alias("n")), batch)

    def attach_embedder(self, embed: Any) -> None:
        """A function from texts to vectors, for upsert_text and search_text; it isn't stored."""
        known = getattr(embed, "dimensions", None)
        if known is not None and known != self.dimensions:
            raise errors.DimensionMismatch(f"the embedder has {known} dimensions, the collection {self.dimensions}")
        self._embed = embed

    def _embedded(self, text: str) -> Sequence[float]:
        if self._embed is None:
            raise errors.EmbedderMissing("no embedder is attached")
        return self._embed([text])[0]

    def upsert_text(self, id: int, text: str, payload: Any = None) -> None:
        self.upsert(id, self._embedded(text), payload)

    def search_text(self, text: str, k: int) -> list[dict]:
        return self.search(self._embedded(text), k)

    # Reading.

    def _read(self, folders: Sequence[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], CHANGES)
        return self.spark.read.schema(CHANGES).parquet(*[f"{self.path}/{x}" for x in folders])

    def changes(self) -> DataFrame:
        """The base's rows and all later changes."""
        return self._read(_batches(self._manifest()))

    def rows(self, snapshot: str | None = None) -> DataFrame:
        """id, vec, payload, sparse of the live rows, now or when a snapshot was made."""
        if snapshot is None:
            manifest = self._manifest()
        elif self.files.exists(path := self._snapshot(snapshot)):
            manifest = json.loads(self.files.read(path))
        else:
            raise errors.SnapshotNotFound(snapshot)
        if manifest["base"] is None:
            return live_rows(self._read(manifest["log"]))
        base = self._read([manifest["base"]]).select("id", "vec", "payload", "sparse")
        if not manifest["log"]:
            return base
        return base.join(self._changed(manifest), "id", "left_anti").unionByName(self._fresh(manifest))

    def _changed(self, manifest: dict) -> DataFrame:
        """The ids that changed since the base: as many as changes at most, which are few beside it."""
        return self._read(manifest["log"]).select("id").distinct()

    def _fresh(self, manifest: dict) -> DataFrame:
        """The live rows among the ids that changed since the base; sparse values come from there where they stay."""
        old = self._read([manifest["base"]]).join(self._changed(manifest), "id", "left_semi")
        return live_rows(old.select(*[f.name for f in CHANGES]).unionByName(self._read(manifest["log"])))

    @property
    def count(self) -> int:
        return self.rows().count()

    @property
    def sparse_count(self) -> int:
        return self.rows().where(F.size("sparse") > 0).count()

    def postings(self) -> DataFrame:
        return self.rows().where(F.size("sparse") > 0).select("id", F.explode("sparse").alias("dim", "w"))

    def _where(self, filter: dict | None) -> Column | None:
        return None if filter is None else compile_filter(filter, F.col("payload"), T.StringType())

    def search_frame(self, query: Sequence[float], k: int, filter: dict | None = None, mode: str = "exact") -> DataFrame:
        """id, distance, payload by the collection's index type; filters restrict the candidates (all of them, if exact)."""
        metrics.check_dimensions(query, self.dimensions)
        kind, where = self.index_type, self._where(filter)
        if kind == "flat" and self._promoted():
            kind = "hnsw"
        exact = where is not None and mode == "exact"
        many = k if where is None or exact else search.OVERSCAN * k
        if kind in ("ivf", "ivf_pq") or (kind == "hnsw" and not exact):
            return self._search_built(kind, query, k, many, where, mode)
        # A graph over all rows could miss what a filter leaves, so a restricted set is searched exactly.
        rows = self.rows().where(where) if exact else self.rows()
        if kind in ("flat", "mmap_flat", "hnsw"):
            return search.knn(rows, query, k, self.metric, keep=["payload"], where=None if exact else where, mode=mode)
        find = {"quantized_flat": search.knn_int8, "fp16_flat": search.knn_fp16, "binary_flat": search.knn_binary}[kind]
        found = find(rows, query, many, self.metric, keep=["payload"])
        if where is not None and not exact:
            found = found.where(where)
        return found.orderBy("distance", "id").limit(max(0, k))

    def _search_built(self, kind: str, query: Sequence[float], k: int, many: int, where: Column | None, mode: str) -> DataFrame:
        """By the index of the base, whose rows carry payloads, and exactly among later changes."""
        made, manifest = self._built()
        if made is None:
            rows = self.rows() if where is None else self.rows().where(where)
            return search.knn(rows, query, k, self.metric, keep=["payload"])
        changed = self._changed(manifest) if manifest["log"] else None
        if kind == "hnsw":
            near = hnsw.search(made, [(0, query)], many, self.metric, self.meta["hnsw"]["ef_search"], changed).select("id", "distance").collect()
            near = [(r.id, r.distance) for r in near]  # many at the most; the base is sorted by id
            payloads = self._read([manifest["base"]]).where(F.col("id").isin([i for i, _ in near])).select("id", "payload")
            found = self.spark.createDataFrame(near, "id long, distance double").join(payloads, "id")
        else:
            centroids, book, lists = made
            if changed is not None:
                lists = lists.join(changed, "id", "left_anti")
            if where is not None and mode == "exact":
                lists = lists.where(where)
            probes = self.meta["ivf"]["nprobe"]
            if kind == "ivf":
                found = cluster.ivf_search(lists, centroids, query, many, probes, self.metric, keep=["payload"])
            else:
                found = cluster.ivfpq_search(lists, centroids, book, query, many, probes, self.metric, keep=["payload"])
        if changed is not None:
            fresh = self._fresh(manifest)
            if where is not None and mode == "exact":
                fresh = fresh.where(where)
            near = search.knn(fresh, query, many, self.metric if kind != "ivf_pq" else "l2", keep=["payload"])
            if kind == "ivf_pq":  # codes give squared distances
                near = near.withColumn("distance", F.col("distance") * F.col("distance"))
            found = found.select("id", "distance", "payload").unionByName(near)
        if where is not None and mode != "exact":
            found = found.orderBy("distance", "id").limit(many).where(where)
        return found.select("id", "distance", "payload").orderBy("distance", "id").limit(max(0, k))

    def search_many(self, queries: DataFrame, k: int) -> DataFrame:
        """qid, id, distance, rank for every row of queries (qid, qvec), a block of them in one pass."""
        kind = "hnsw" if self.index_type == "flat" and self._promoted() else self.index_type
        if kind not in ("ivf", "hnsw"):
            return search.knn_batch(self.rows(), queries, k, self.metric)
        made, manifest = self._built()
        if made is None:
            return search.knn_batch(self.rows(), queries, k, self.metric)
        changed = self._changed(manifest) if manifest["log"] else None
        if kind == "hnsw":
            found = hnsw.search_frame(made, queries, k, self.metric, self.meta["hnsw"]["ef_search"], changed)
        else:
            centroids, _, lists = made
            lists = lists if changed is None else lists.join(changed, "id", "left_anti")
            found = cluster.ivf_search_frame(lists, centroids, queries, k, self.meta["ivf"]["nprobe"], self.metric)
        if changed is None:
            return found
        both = found.unionByName(search.knn_batch(self._fresh(manifest), queries, k, self.metric))
        own = Window.partitionBy("qid").orderBy("distance", "id")
        return both.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k)

    def _promoted(self) -> bool:
        """Whether a flat collection has grown to its promotion threshold; once it has, the base says so."""
        n, manifest = self.meta.get("promotion_threshold"), self._manifest()
        if n is None or manifest["promoted"]:
            return manifest["promoted"]
        if manifest["rows"] + manifest["changes"] < n or self.count < n:
            return False
        self._commit(manifest | {"promoted": True}, same=True)
        return True

    def search(self, query: Sequence[float], k: int, filter: dict | None = None, mode: str = "exact") -> list[dict]:
        return [_result(r, {"id": r.id, "distance": r.distance}) for r in self.search_frame(query, k, filter, mode).collect()]

    def search_hybrid(self, dense_query: Sequence[float], sparse_query: dict, k: int, dense_weight: float = fusion.DENSE_WEIGHT, sparse_weight: float = fusion.SPARSE_WEIGHT, filter: dict | None = None, mode: str = "exact") -> list[dict]:
        metrics.check_dimensions(dense_query, self.dimensions)
        rows = self.rows()
        found = fusion.hybrid(rows, self.postings(), dense_query, sparse_query, k, self.metric, dense_weight, sparse_weight, self._where(filter), mode=mode)
        out = found.join(rows.select("id", "payload"), "id").orderBy(F.desc("score"), "id").collect()
        return [_result(r, {"id": r.id, "score": r.score, "dense_distance": r.dense_distance, "sparse_score": r.sparse_score}) for r in out]

    def search_sparse(self, sparse_query: dict, k: int) -> list[dict]:
        return [{"id": r.id, "score": r.score} for r in sparse_top(self.postings(), sparse_query, k).collect()]

    # Indexes that are built: kept for the version of the rows that they were built from.

    def build(self) -> None:
        """Make base and index anew."""
        self.compact()
        self._built()

    def _built(self) -> tuple[Any, dict]:
        """The index (none, if its base has no rows), and the manifest whose base it belongs to."""
        manifest = self._manifest()
        if manifest["base"] is None or manifest["changes"] > max(STAGED, STAGED_SHARE * manifest["rows"]):
            self.compact()
            manifest = self._manifest()
        if not manifest["rows"]:
            return None, manifest
        folder = f"{self.path}/index/{manifest['base'].rsplit('/', 1)[1]}"
        if self._index is None or self._index[0] != folder:
            if not self.files.exists(f"{folder}/about.json"):
                self.files.delete(folder)
                about = self._make(self._read([manifest["base"]]).select("id", "vec", "payload"), f"{folder}/rows")
                self.files.write(f"{folder}/about.json", json.dumps(about))
            about = json.loads(self.files.read(f"{folder}/about.json"))
            rows = self.spark.read.parquet(f"{folder}/rows")
            self._index = folder, rows if "centroids" not in about else (np.array(about["centroids"]), None if about["book"] is None else np.array(about["book"]), rows)
        return self._index[1], manifest

    def _make(self, rows: DataFrame, folder: str) -> dict:
        """Write the index of rows; what was trained is returned, to be stored beside it."""
        if self.index_type in ("hnsw", "flat"):
            h = self.meta["hnsw"]
            hnsw.build(rows, self.metric, h["m"], h["ef_construction"]).write.parquet(folder)
            return {}
        i = self.meta["ivf"]
        centroids, book = cluster.kmeans(rows, i["n_lists"], self.metric, i["max_iter"]), None
        if self.index_type == "ivf_pq":
            book = cluster.pq_train(cluster.residuals(rows, centroids, self.metric), i["pq_m"], i["pq_k_sub"])
            lists = cluster.ivfpq_encode(rows, centroids, book, self.metric, keep=["payload"])
        else:
            lists = cluster.assign(rows, centroids, self.metric, keep=["payload"])
        cluster.write_lists(lists, folder)
        return {"centroids": centroids.tolist(), "book": None if book is None else book.tolist()}

    # Compaction and snapshots.

    def maybe_compact(self) -> bool:
        manifest = self._manifest()
        return self.compact() if manifest["changes"] >= max(self.meta["compaction_threshold"], DEAD_SHARE * manifest["rows"]) else False

    def compact(self) -> bool:
        """Write the live rows as a new base; batches that a snapshot names stay on disk."""
        manifest = self._manifest()
        seq, old = manifest["seq"] + 1, _batches(manifest)
        folder = f"log/{seq:012d}-{uuid.uuid4().hex[:8]}"
        rows = self.rows().select(F.lit(seq).cast("long").alias("seq"), F.lit(0).cast("long").alias("n"), F.lit("put").alias("op"), "id", "vec", "payload", "sparse")
        rows.repartitionByRange("id").sortWithinPartitions("id").write.parquet(f"{self.path}/{folder}")
        n = self.spark.read.parquet(f"{self.path}/{folder}").count()
        self._commit(manifest | {"base": folder, "log": [], "seq": seq, "rows": n, "changes": 0}, same=True)
        self._sweep(old)
        return True

    def _sweep(self, folders: Sequence[str]) -> None:
        kept = [json.loads(self.files.read(f"{self.path}/snapshots/{s['name']}.json")) for s in self.list_snapshots()]
        used = {x for m in [*kept, self._manifest()] for x in _batches(m)}
        for x in folders:
            if x not in used:
                self.files.delete(f"{self.path}/{x}")
                self.files.delete(f"{self.path}/index/{x.rsplit('/', 1)[1]}")

    def _snapshot(self, name: str) -> str:
        return f"{self.path}/snapshots/{check_name(name)}.json"

    def create_snapshot(self, name: str) -> dict:
        if self.files.exists(path := self._snapshot(name)):
            raise errors.SnapshotExists(name)
        info = {"name": name, "created_at": int(time.time()), "vector_count": self.count, "sparse_count": self.sparse_count}
        self.files.write(path, json.dumps(info | {k: self._manifest()[k] for k in STATE}))
        return info

    def list_snapshots(self) -> list[dict]:
        found = [json.loads(self.files.read(f"{self.path}/snapshots/{x}")) for x in self.files.names(f"{self.path}/snapshots") if x.endswith(".json")]
        return sorted(({k: v for k, v in x.items() if k not in STATE} for x in found), key=lambda x: (x["created_at"], x["name"]))

    def restore_snapshot(self, name: str) -> None:
        if not self.files.exists(path := self._snapshot(name)):
            raise errors.SnapshotNotFound(name)
        manifest, saved = self._manifest(), json.loads(self.files.read(path))
        self._commit(manifest | {k: saved[k] for k in STATE})
        self._sweep(_batches(manifest))

    def delete_snapshot(self, name: str) -> None:
        if not self.files.exists(path := self._snapshot(name)):
            raise errors.SnapshotNotFound(name)
        saved = json.loads(self.files.read(path))
        self.files.delete(path)
        self._sweep(_batches(saved))


def live_rows(changes: DataFrame, id: str = "id") -> DataFrame:
    """The latest change of each id by (seq, n), without those deleted; sparse carries forward within a life.

    For changes since a base, which are few: each task combines its own by a sorted aggregate before the shuffle.
    """
    order = F.struct("seq", "n")
    last = F.max_by(F.struct("op", "vec", "payload"), order)
    gone = F.max(F.when(F.col("op") == "delete", order))
    given = F.max(F.when(F.col("sparse").isNotNull(), F.struct("seq", "n")))
    sparse = F.max_by("sparse", F.when(F.col("sparse").isNotNull(), order))
    found = changes.groupBy(id).agg(last.alias("x"), gone.alias("gone"), given.alias("given"), sparse.alias("s")).where("x.op <> 'delete'")
    kept = F.when(F.col("gone").isNull() | (F.col("given") > F.col("gone")), F.col("s"))
    return found.select(id, F.col("x.vec").alias("vec"), F.col("x.payload").alias("payload"), kept.alias("sparse"))


def latest(changes: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key in an order, by a window; for tables with many columns."""
    own = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return changes.withColumn("__n", F.row_number().over(own)).where("__n = 1").drop("__n")


def _result(row: Any, out: dict) -> dict:
    return out if row.payload is None else out | {"payload": json.loads(row.payload)}


class Client:
    """Collections under one folder; at most ``loaded`` of them keep what they have built, those used last."""

    loaded = 32

    def __init__(self, spark: SparkSession, path: str = "./data"):
        self.spark, self.path, self.files = spark, path.rstrip("/"), Files(spark, path)
        self.open: dict[str, Collection] = {}

    def create_collection(self, name: str, dimensions: int, metric: str = "cosine", index_type: str = "hnsw", *, hnsw: dict | None = None, ivf: dict | None = None, compaction_threshold: int = COMPACTION, promotion_threshold: int | None = None) -> Collection:
        check_name(name)
        metrics.check_metric(metric)
        if index_type not in INDEX_TYPES:
            raise errors.InvalidConfig(f"unknown index type {index_type!r}")
        if dimensions < 1:
            raise errors.InvalidConfig("at least one dimension is needed")
        folder = f"{self.path}/{name}"
        if self.files.exists(f"{folder}/meta.json"):
            raise errors.CollectionExists(name)
        meta = {
            "name": name, "dimensions": dimensions, "metric": metric, "index_type": index_type, "compaction_threshold": compaction_threshold, "promotion_threshold": promotion_threshold,
            "hnsw": {"m": 12, "ef_construction": 200, "ef_search": 50} | (hnsw or {}),
            "ivf": {"n_lists": 256, "nprobe": 16, "max_iter": 10, "pq_m": 8, "pq_k_sub": 256} | (ivf or {}),
        }
        if index_type == "ivf_pq" and dimensions % meta["ivf"]["pq_m"]:
            raise errors.InvalidConfig("the dimensions must be a multiple of pq_m")
        self.files.write_next(f"{folder}/manifest", {"base": None, "log": [], "rows": 0, "changes": 0, "seq": 0, "named": [], "promoted": False, "version": uuid.uuid4().hex})
        self.files.write(f"{folder}/meta.json", json.dumps(meta, indent=1))
        return self.get_collection(name)

    def get_collection(self, name: str) -> Collection:
        if not self.files.exists(f"{self.path}/{check_name(name)}/meta.json"):
            raise errors.CollectionNotFound(name)
        found = self.open.pop(name, None) or Collection(self.spark, f"{self.path}/{name}")
        self.open[name] = found  # the last used is the last
        while len(self.open) > self.loaded:
            self.open.pop(next(iter(self.open)))
        return found

    def get_or_create_collection(self, name: str, dimensions: int, metric: str = "cosine", index_type: str = "hnsw", **options: Any) -> Collection:
        try:
            return self.get_collection(name)
        except errors.CollectionNotFound:
            return self.create_collection(name, dimensions, metric, index_type, **options)

    def delete_collection(self, name: str) -> bool:
        self.open.pop(name, None)
        return self.files.exists(f"{self.path}/{check_name(name)}/meta.json") and self.files.delete(f"{self.path}/{name}")

    def list_collections(self) -> list[str]:
        """The names of what can be opened; broken collections are skipped with a warning."""
        out = []
        for name in self.files.names(self.path):
            if self.files.exists(f"{self.path}/{name}/meta.json"):
                try:
                    json.loads(self.files.read(f"{self.path}/{name}/meta.json"))["dimensions"]
                    self.files.read_last(f"{self.path}/{name}/manifest")
                    out.append(name)
                except (ValueError, KeyError, FileNotFoundError) as e:
                    warnings.warn(f"collection {name!r} is broken and skipped: {e}", stacklevel=2)
        return out
