"""Operator 6: sharding by extendible hashing, in DataFrame operations only.

A row's address is 60 bits of the md5 of its key, then 60 bits of the md5 of its text. A bucket of rows that
share an address prefix splits on the next bit only if it holds more than ``limit`` bytes and more than one
row; the directory lists each bucket that stays, by its prefix. So a shard is over the limit only where it is
a single row. Rows that agree in all 120 bits are copies of one row; if they are over the limit together they
are dealt to numbered overflow pages of at most ``limit`` bytes.

The directory is built from a histogram of prefixes a few bits longer than an even split needs (aggregated
before the shuffle); only rows of buckets that this histogram can't split are looked at again, with all bits.

Null keys are hashed as the empty string and null texts hold no bytes; repeated rows go to the same shard until
they overflow; an empty table gives no rows; other columns are kept by ``write_shards`` and ignored elsewhere.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import column, materialize

BITS = 60
#: Production size of a shard.
LIMIT = 8 << 20


def _bits60(x: Column) -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(x.cast("string"), F.lit("")).cast("binary")), 1, BITS // 4), 16, 10).cast("long")


def _prefix(address: str | Column, depth: int | Column) -> Column:
    address = F.col(address) if isinstance(address, str) else address
    if isinstance(depth, int):
        return F.shiftright(address, BITS - depth)
    return F.call_function("shiftright", address, (F.lit(BITS) - depth).cast("int"))


def _label(address: str, depth: Column) -> Column:
    return F.when(depth == 0, "").otherwise(F.lpad(F.bin(_prefix(address, depth)), depth, "0"))


def _split(rows: DataFrame, group: list[str], address: str, low: int, high: int, limit: int) -> DataFrame:
    """By group and prefix of ``high`` bits: the depth, bytes and rows of the bucket it ends in; depth null if none fits."""
    fine = rows.groupBy(*group, _prefix(address, high).alias("fine")).agg(F.sum("n_bytes").alias("b"), F.count("*").alias("n"))
    every = fine.select("*", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("depth"))
    every = every.withColumn("p", F.call_function("shiftright", F.col("fine"), (F.lit(high) - F.col("depth")).cast("int")))
    sums = every.groupBy(*group, "depth", "p").agg(F.sum("b").alias("shard_bytes"), F.sum("n").alias("shard_docs"))
    fits = sums.where((F.col("shard_bytes") <= limit) | (F.col("shard_docs") == 1))
    found = every.join(fits, [*group, "depth", "p"], "left").groupBy(*group, "fine")
    kept = F.struct("depth", "shard_bytes", "shard_docs")
    return found.agg(F.min(F.when(F.col("shard_docs").isNotNull(), kept)).alias("x")).select(*group, "fine", "x.*")


def assign_shards(docs: DataFrame, limit: int = LIMIT, key: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """doc_id, n_bytes, shard (its prefix in bits, with /page in overflow), depth, shard_bytes, shard_docs; and the columns of keep."""
    keep = keep or []
    size = F.coalesce(F.octet_length(column(text)), F.lit(0)).cast("long")
    rows = docs.select(column(key).alias("doc_id"), size.alias("n_bytes"), _bits60(column(key)).alias("a"), *[column(c) for c in keep])
    hashed = docs.select(_bits60(column(key)).alias("a"), _bits60(column(text)).alias("c"), column(key).alias("doc_id"), size.alias("n_bytes"), *[column(c) for c in keep])
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    high = 0 if total <= limit else min(BITS, math.ceil(math.log2(total / limit)) + 4)
    first = materialize(_split(rows.select("a", "n_bytes"), [], "a", 0, high, limit), "directory")
    shape = ["doc_id", "n_bytes", "shard", "depth", "shard_bytes", "shard_docs", *keep]
    joined = rows.withColumn("fine", _prefix("a", high)).join(first, "fine")
    done = joined.where("depth is not null").withColumn("shard", _label("a", F.col("depth"))).select(*shape)
    if first.where("depth is null").isEmpty():
        return done
    # Buckets that the histogram couldn't split: the other bits of the key, then those of the text.
    over = hashed.withColumn("fine", _prefix("a", high)).join(first.where("depth is null").select("fine"), "fine").drop("fine")
    second = materialize(_split(over.select("a", "n_bytes"), [], "a", high, BITS, limit), "directory")
    joined = over.join(second.withColumnRenamed("fine", "a"), "a")
    done = done.unionByName(joined.where("depth is not null").withColumn("shard", _label("a", F.col("depth"))).select(*shape))
    if second.where("depth is null").isEmpty():
        return done
    over = over.join(second.where("depth is null").select(F.col("fine").alias("a")), "a")
    third = materialize(_split(over.select("a", "c", "n_bytes"), ["a"], "c", 1, BITS, limit), "directory")
    joined = over.join(third.withColumnRenamed("fine", "c"), ["a", "c"])
    label = F.concat(_label("a", F.lit(BITS)), _label("c", F.col("depth")))
    done = done.unionByName(joined.where("depth is not null").select("*", label.alias("shard")).withColumn("depth", F.col("depth") + BITS).select(*shape))
    if third.where("depth is null").isEmpty():
        return done
    # Copies of one row: numbered within each input partition, then across partitions.
    over = over.join(third.where("depth is null").select("a", F.col("fine").alias("c")), ["a", "c"])
    over = materialize(over.withColumn("part", F.spark_partition_id()), "overflow")
    counts = over.groupBy("a", "c", "part").count()
    before = counts.withColumn("before", F.sum("count").over(Window.partitionBy("a", "c").orderBy("part")) - F.col("count")).drop("count")
    within = F.row_number().over(Window.partitionBy("a", "c", "part").orderBy("doc_id")) - 1
    page = F.floor((F.col("before") + F.col("within")) / F.greatest(F.lit(1), F.floor(F.lit(limit) / F.col("n_bytes"))))
    paged = over.withColumn("within", within).join(before, ["a", "c", "part"]).withColumn("page", page)
    paged = paged.withColumn("shard", F.concat(_label("a", F.lit(BITS)), _label("c", F.lit(BITS)), F.lit("/"), F.col("page").cast("string")))
    pages = paged.groupBy("shard").agg(F.sum("n_bytes").alias("shard_bytes"), F.count("*").alias("shard_docs"))
    return done.unionByName(paged.join(pages, "shard").withColumn("depth", F.lit(2 * BITS)).select(*shape))


def write_shards(docs: DataFrame, path: str, limit: int = LIMIT, key: str = "doc_id", text: str = "text") -> None:
    """Write every column of docs as Parquet, in one folder for each shard (column __shard)."""
    columns = docs.columns
    wrapped = docs.select(column(key).alias("__key"), column(text).alias("__body"), F.struct(*[column(c) for c in columns]).alias("__row"))
    out = assign_shards(wrapped, limit, "__key", "__body", ["__row"]).select("__row.*", F.col("shard").alias("__shard"))
    out.repartition("__shard").write.partitionBy("__shard").parquet(path)


def oracle(limit: int = LIMIT) -> str:
    """DuckDB SQL for assign_shards over documents, for tables whose buckets all fit within 24 bits."""
    return f"""
with d as (
  select doc_id, coalesce(octet_length(encode(text)), 0) as n_bytes,
         ('0x' || substr(md5(coalesce(cast(doc_id as varchar), '')), 1, 15))::bigint as a
  from documents),
g as (select a, sum(n_bytes) as n_bytes, count(*) as n from d group by a),
s as (
  select depth, g.a >> (60 - depth) as p, sum(n_bytes) as b, sum(n) as n
  from g, (select unnest(range(0, 25)) as depth) group by all),
r as (
  select g.a, min(s.depth) as depth from g, s
  where s.p = (g.a >> (60 - s.depth)) and (s.b <= {limit} or s.n = 1) group by g.a)
select d.doc_id, cast(d.n_bytes as bigint) as n_bytes,
       case when r.depth = 0 then '' else lpad(bin(d.a >> (60 - r.depth)), cast(r.depth as integer), '0') end as shard,
       cast(r.depth as integer) as depth, cast(s.b as bigint) as shard_bytes, cast(s.n as bigint) as shard_docs
from d join r on d.a = r.a join s on s.depth = r.depth and s.p = (d.a >> (60 - r.depth))"""
