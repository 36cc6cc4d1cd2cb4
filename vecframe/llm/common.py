"""Shared helpers: reading tables, shared-folder materialisation and Arrow batches."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; in local mode, where it may be unset, a temporary one."""
    conf = spark.sparkContext.getConf()
    root = conf.get("spark.checkpoint.dir", None)
    if root is None:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = known.get() if known.isDefined() else None
    if root is None:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="vecframe-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(root)
        root = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return root.rstrip("/")


def scratch(spark: SparkSession, tag: str) -> str:
    """A fresh path in the shared folder, deleted when the application ends."""
    path = f"{shared_root(spark)}/vecframe/{tag}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def materialize(df: DataFrame, tag: str, codec: str = "zstd") -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: lineage is cut and a lost executor costs nothing."""
    path = scratch(df.sparkSession, tag)
    df.write.option("compression", codec).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete what materialize wrote, once nothing reads it any more."""
    jvm = df.sparkSession.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(df._scratch_path)
    target.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def slices(batches: Iterable[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batches in parts of few rows, so that what Python holds of their texts at once is small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


_HELD: dict = {}


def worker_cache(name: Any, make: Callable[[], Any]) -> Any:
    """What a Python worker keeps between tasks: the caches of one operator at a time, so that their sizes don't add up."""
    if name not in _HELD:
        _HELD.clear()
        _HELD[name] = make()
    return _HELD[name]


class RecentCache(dict):
    """value = cache[key], made on a miss; beyond ``limit`` entries those not used since the last turn are dropped."""

    def __init__(self, make: Callable[[Any], Any], limit: int):
        super().__init__()
        self.make, self.limit, self.old = make, limit // 2, {}

    def __missing__(self, key: Any) -> Any:
        out = self.old.get(key)
        if out is None:
            out = self.make(key)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = out
        return out


def binary_texts(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """UTF-8 of each text; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def column(name: str) -> Column:
    """The column of exactly that name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def plain_names(df: DataFrame) -> DataFrame:
    """df with its columns named c0, c1 and so on, which clash with no name of ours; ``toDF(*df.columns)`` undoes it."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with as many underscores ahead as it takes for df to have none of them."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out


def row_keys(key: str, *columns: str) -> list[Column]:
    """Two hashes, ka and kb, that identify a row by its content; equal rows share them, nulls included."""
    parts = [column(c) for c in (key, *columns)]
    return [F.xxhash64(*parts).alias("ka"), F.xxhash64(F.lit(1), *reversed(parts)).alias("kb")]
