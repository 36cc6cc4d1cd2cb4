"""A bounded, deterministic sample of labelled documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column


def held_out(key, modulus: int, remainder: int):
    """Whether crc32 of the key as text leaves the remainder; a null key counts as the empty string."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, modulus: int, remainder: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, label, text of at most ``rows`` labelled keys that aren't held out: those with the least hashes.

    At most ``rows`` (key, label) pairs are broadcast; documents are only scanned. Null keys and labels don't count.
    """
    known = labels.where(column(label).isNotNull() & column(key).isNotNull() & ~held_out(column(key), modulus, remainder))
    known = known.groupBy(column(key).alias("doc_id")).agg(F.max(column(label)).cast("int").alias("label"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return docs.select(column(key).alias("doc_id"), column(text).alias("text")).join(F.broadcast(known), "doc_id")
