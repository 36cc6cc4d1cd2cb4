"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import avi, chunk_bpe, compress_quality, extendible, log_templates, simhash_vp, substring_dedup, token_store, toxicity, winnow
from .common import scratch, table
from .labelled import held_out


def op1_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "token-shards")
    token_store.write_token_shards(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return token_store.read_token_shards(spark, path)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), kept=False)


def op3_avi_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return avi.probe_media(avi.store(table(spark, sf_dir, "documents")))


def op4_toxicity_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    held = held_out(F.col("doc_id"), toxicity.MODULUS, toxicity.REMAINDER)
    out = toxicity.score(docs, model)
    return out.select("doc_id", held.alias("held_out"), "score", "predicted", "n_sentences", "worst_sentence", F.size("offending").alias("n_offending"))


def op5_log_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_templates.digest(log_templates.dedup_lines(table(spark, sf_dir, "documents")))


def op6_extendible_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extendible.assign_shards(table(spark, sf_dir, "documents"))


#: A limit at which the smallest tables have several shards; op6 itself has the production limit.
SMALL_LIMIT = 64 << 10


def shards_of_64k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extendible.assign_shards(table(spark, sf_dir, "documents"), SMALL_LIMIT)


def op7_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = compress_quality.fit(docs, table(spark, sf_dir, "labels"))
    held = held_out(F.col("doc_id"), compress_quality.MODULUS, compress_quality.REMAINDER)
    return compress_quality.score(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted", "difference")


def op8_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("ka", "kb")


def op9_chunk_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_bpe.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_simhash_vp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_vp.near_duplicates(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_token_shards, op2_suffix_dedup, op3_avi_media, op4_toxicity_mil, op5_log_templates, op6_extendible_shards,
        op7_compression_quality, op8_winnowing, op9_chunk_bpe, op10_simhash_vp, shards_of_64k,
    )
}

ORACLE_SQL: dict[str, str] = {"op6_extendible_shards": extendible.oracle(), "shards_of_64k": extendible.oracle(SMALL_LIMIT), "op8_winnowing": winnow.ORACLE}
