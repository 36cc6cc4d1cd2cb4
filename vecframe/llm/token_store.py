"""Operator 1: token-id output in binary shards, with keyed access by minimal perfect hashing.

The file format is a Parquet dataset with one row per shard:

* ``part, seq`` order the shards; ``part_start`` is the ids of the same part before the shard;
* ``payload`` is the raw little-endian ids (``width`` bytes each) of the shard's rows, end id included;
* ``offsets`` (uint64, rows + 1) bound each row's ids in the payload; ``keys`` and ``null_key`` name the rows;
* ``index`` is a minimal perfect hash of the shard's distinct keys with stored fingerprints, and
  ``first_row`` / ``row_count`` give, by its slots, the rows of a key;
* ``min_key, max_key`` route a key to its shards (Parquet statistics prune the others).

Rows are in ascending key order, nulls first; rows of equal key are ordered by a hash of their text (null before
empty), and copies by where they were read, so that even one key's rows are dealt to many tasks. A shard is closed
when its payload reaches ``shard_bytes``, so it holds at most that plus one document. Null text is empty (its only
id is the end id); an empty table makes an empty dataset; other columns are ignored.

A key is looked up in constant time: its shard by the key ranges, its slot by one probed bit a level and a sampled
rank, and of the payload only the key's own bytes leave the files' reader.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, slices, worker_cache
from .mph import PerfectHash
from .wordcache import ByteLevelEncoder

SHARD = "part int, seq int, part_start long, n_rows long, n_tokens long, width int, min_key long, max_key long, payload binary, offsets binary, keys binary, null_key binary, index binary, first_row binary, row_count binary"
SHARD_BYTES = 4 << 20


def _shard(part: int, seq: int, part_start: int, width: int, keys: list, ids: list[bytes]) -> dict:
    null = np.array([k is None for k in keys], np.uint8)
    values = np.array([0 if k is None else k for k in keys], "<i8")
    offsets = np.cumsum([0, *map(len, ids)]) // width
    named = values[null == 0]
    distinct, first, count = np.unique(named, return_index=True, return_counts=True)
    index = PerfectHash.build(distinct)
    slots = index.slots(distinct)
    first_row, row_count = np.zeros(len(distinct), "<u4"), np.zeros(len(distinct), "<u4")
    first_row[slots], row_count[slots] = first + int(null.sum()), count  # nulls come first
    return {
        "part": part, "seq": seq, "part_start": part_start, "n_rows": len(keys), "n_tokens": int(offsets[-1]), "width": width,
        "min_key": int(distinct[0]) if len(distinct) else None, "max_key": int(distinct[-1]) if len(distinct) else None,
        "payload": b"".join(ids), "offsets": offsets.astype("<u8").tobytes(), "keys": values.tobytes(), "null_key": null.tobytes(),
        "index": index.dump(), "first_row": first_row.tobytes(), "row_count": row_count.tobytes(),
    }


def order_of_text(text: str) -> Column:
    """What rows of equal key are ordered by."""
    return F.when(F.col(text).isNotNull(), F.xxhash64(text))


def write_token_shards(docs: DataFrame, path: str, tokenizer: str, key: str = "doc_id", text: str = "text", end_id: int = 2, shard_bytes: int = SHARD_BYTES) -> None:
    """Encode every text, append end_id and write the shards described above to path."""
    from tokenizers import Tokenizer

    width = 2 if max(Tokenizer.from_file(tokenizer).get_vocab_size(), end_id + 1) <= 1 << 16 else 4
    dtype, end = f"<u{width}", int(end_id).to_bytes(width, "little")

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = worker_cache(("token-store", tokenizer, dtype), lambda: ByteLevelEncoder(tokenizer, dtype))
        part, seq, start, size, keys, ids = TaskContext.get().partitionId(), 0, 0, 0, [], []
        for batch in slices(batches, 2000):
            for k, found in zip(batch.column(0).to_pylist(), code.many([t or "" for t in batch.column(1).to_pylist()]), strict=True):
                ids.append(found + end)
                keys.append(k)
                size += len(ids[-1])
                if size >= shard_bytes:
                    yield pa.RecordBatch.from_pylist([row := _shard(part, seq, start, width, keys, ids)], schema)
                    seq, start, size, keys, ids = seq + 1, start + row["n_tokens"], 0, [], []
        if keys:
            yield pa.RecordBatch.from_pylist([_shard(part, seq, start, width, keys, ids)], schema)

    schema = _arrow_schema()
    rows = docs.select(column(key).cast("long").alias("k"), column(text).alias("t")).select("*", order_of_text("t").alias("h"), F.monotonically_increasing_id().alias("i"))
    rows.repartitionByRange("k", "h", "i").sortWithinPartitions("k", "h", "i").select("k", "t").mapInArrow(encode, SHARD).write.option("compression", "zstd").parquet(path)


def _arrow_schema() -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in SHARD.split(", "))])


def read_token_shards(spark: SparkSession, path: str) -> DataFrame:
    """One row per document, from the files: doc_id, start (ids before it), n_tokens, ids_crc32, shard, by_index.

    Every row is found through its shard's perfect hash; ``by_index`` is false only for null keys, which
    the index doesn't hold. What is gathered on the driver is one total for each writing task.
    """
    shards = spark.read.schema(SHARD).parquet(path)
    totals = {r.part: r.n for r in shards.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()}
    ends = np.cumsum([0, *(totals[p] for p in sorted(totals))])
    base = dict(zip(sorted(totals), ends.tolist(), strict=False))

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.to_pylist():
                keys, null = np.frombuffer(x["keys"], "<i8"), np.frombuffer(x["null_key"], np.uint8) == 1
                row = np.arange(len(keys))
                lead = int(null.sum())
                slots = PerfectHash.load(x["index"]).slots(keys[lead:])
                first, count = np.frombuffer(x["first_row"], "<u4"), np.frombuffer(x["row_count"], "<u4")
                nth = row[lead:] - lead - np.searchsorted(keys[lead:], keys[lead:])  # which of the rows with this key
                if (slots < 0).any() or (nth >= count[slots]).any():
                    raise ValueError("a shard's index doesn't match its keys")
                row[lead:] = first[slots] + nth
                offsets = np.frombuffer(x["offsets"], "<u8").astype(np.int64)
                ids = memoryview(np.frombuffer(x["payload"], f"<u{x['width']}").astype("<u4").tobytes())
                a, b = offsets[row], offsets[row + 1]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(keys, pa.int64(), mask=null), pa.array(a + base[x["part"]] + x["part_start"], pa.int64()), pa.array(b - a, pa.int64()),
                        pa.array([zlib.crc32(ids[4 * i : 4 * j]) for i, j in zip(a.tolist(), b.tolist(), strict=True)], pa.int64()),
                        pa.array([f"{x['part']}-{x['seq']}"] * len(keys)), pa.array(~null),
                    ],
                    ["doc_id", "start", "n_tokens", "ids_crc32", "shard", "by_index"],
                )

    return shards.mapInArrow(rows, "doc_id long, start long, n_tokens long, ids_crc32 long, shard string, by_index boolean")


def lookup(spark: SparkSession, path: str, key: int) -> list[list[int]]:
    """The ids of each row of a key, end id included; empty for a key that isn't there."""
    shards = spark.read.schema(SHARD).parquet(path)
    index = shards.where((F.col("min_key") <= key) & (F.col("max_key") >= key)).select("part", "seq", "width", "index", "first_row", "row_count").orderBy("part", "seq")
    out = []
    for x in index.toLocalIterator():
        slot = PerfectHash.probe(x["index"], key)
        if slot < 0:
            continue
        first, n = (struct.unpack_from("<I", x[c], 4 * slot)[0] for c in ("first_row", "row_count"))
        one = shards.where((F.col("part") == x["part"]) & (F.col("seq") == x["seq"]))
        near = one.select(F.substring("keys", 8 * first + 1, 8).alias("key"), F.substring("offsets", 8 * first + 1, 8 * (n + 1)).alias("offsets")).first()
        if struct.unpack("<q", near["key"])[0] != key:  # a foreign key with the same fingerprint
            continue
        offsets = np.frombuffer(near["offsets"], "<u8").astype(np.int64)
        low, high = int(offsets[0]) * x["width"], int(offsets[-1]) * x["width"]
        ids = np.frombuffer(one.select(F.substring("payload", low + 1, high - low).alias("ids")).first()["ids"], f"<u{x['width']}")
        out += [ids[a:b].tolist() for a, b in zip(offsets - offsets[0], offsets[1:] - offsets[0], strict=False)]
    return out
