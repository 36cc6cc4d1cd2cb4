"""The corpus pipeline: toxicity, line dedup, near-dedup, benchmark decontamination, BPE, in this order.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; its result is written as Parquet
and read again as the next one's documents. All but the last return the columns of documents. Null texts and keys,
empty texts, repeated rows and empty tables are handled as each operator's module says; of rows that are wholly
equal, near-dedup keeps one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecframe.llm import chunk_bpe, log_templates, simhash_vp, toxicity, winnow
from vecframe.llm.common import materialize, plain_names, row_keys, table


def private(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """docs under names that clash with none of the operators', and what doc_id and text are called there."""
    return plain_names(docs), f"c{docs.columns.index('doc_id')}", f"c{docs.columns.index('text')}"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4, trained on the labels beside the documents: rows of a score of 0.5 or more go."""
    model = toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    plain, key, text = private(docs)
    clean = toxicity.score(plain, model, key, text, keep=plain.columns, sentences=False).where("predicted = 0")
    return clean.select(*[f"kept_{i}" for i in range(len(docs.columns))]).toDF(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: lines of recurring templates go; every document stays."""
    plain, key, text = private(docs)
    out = log_templates.dedup_lines(plain, key, text)
    if "n_chars" in docs.columns:
        size = f"c{docs.columns.index('n_chars')}"
        out = out.withColumn(size, F.when(F.col(text).isNotNull(), F.length(text)).cast(docs.schema["n_chars"].dataType))
    return out.select(*plain.columns).toDF(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: of each component the row of the least doc_id stays (nulls last)."""
    plain, key, text = private(docs)
    keys = row_keys(key, text)
    found = simhash_vp.near_duplicates(plain.select(key, text, *keys), key, text, keep=["ka", "kb"])
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("kept_0").alias("ka"), F.col("kept_1").alias("kb"))
    first = found.groupBy("class_fp").agg(F.min(order).alias("o")).select("o.ka", "o.kb")
    first = materialize(first.distinct(), "kept-documents")
    kept = plain.select("*", *keys).join(first, ["ka", "kb"], "left_semi")
    return kept.dropDuplicates(["ka", "kb"]).select(*plain.columns).toDF(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: rows with 5 % or more of their words inside benchmark windows go."""
    plain, key, text = private(docs)
    found = winnow.decontaminate(plain, table(spark, sf_dir, "benchmark"), key, text).where("contaminated").select("ka", "kb").distinct()
    found = materialize(found, "contaminated")
    return winnow.with_keys(plain, key, text).join(found, ["ka", "kb"], "left_anti").select(*plain.columns).toDF(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: token counts and digests of what is left."""
    return chunk_bpe.encode_decode(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_lines),
    ("SimHash near-dedup", drop_copies),
    ("benchmark decontamination", drop_contaminated),
    ("BPE encoding and decoding", encode),
]

#: SQL can't express training, templates or the vocabulary; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
