"""Stored inverted lists: keyword search reads its words' lists, not the texts.

An index is a folder: of parts, each with ``postings/bucket=<b>`` (term, id, tf, dl, v), ``terms/bucket=<b>``
(term, df) and ``removed`` (id, v), and ``about/<n>.json`` (the parts that count; numbers of documents and tokens). A bucket is a hash of the term, so a query reads the folders
of its own words, and of those the row groups that can hold them, as files are sorted by term. Writes append: a version
v counts them, a removal hides an id's postings up to its version, and numbers in terms and totals are added up.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tokenize_one
from ..operators import keyword
from .store import Files

#: Folders of terms, and files that one of them gets at a time (a hot term's rows are dealt to as many tasks).
BUCKETS, DEALT = 64, 4
NUMBERS = "term string, df long"


def bucket(term: Column, buckets: int) -> Column:
    return (F.crc32(term.cast("binary")) % buckets).cast("int")


class KeywordIndex:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.files = spark, path.rstrip("/"), Files(spark, path)
        self.about = self.files.read_last(f"{self.path}/about")

    @classmethod
    def create(cls, spark: SparkSession, path: str, buckets: int = BUCKETS) -> KeywordIndex:
        path = path.rstrip("/")
        Files(spark, path).write_next(f"{path}/about", {"buckets": buckets, "version": 0, "parts": [], "totals": [0, 0], "of": None})
        return cls(spark, path)

    @classmethod
    def build(cls, docs: DataFrame, path: str, id: str = "id", text: str = "text", buckets: int = BUCKETS) -> KeywordIndex:
        """The index of the texts; one of an id."""
        out = cls.create(docs.sparkSession, path, buckets)
        out.add(docs, id, text)
        return out

    def _read(self, name: str, schema: str, terms: list[str] | None = None) -> DataFrame:
        """Rows of all parts; with terms those of the terms, from their folders only."""
        roots, out = [f"{self.path}/{p}/{name}" for p in self.about["parts"]], None
        for root in roots:
            paths = [root] if terms is None else [f"{root}/bucket={b}" for b in sorted({zlib.crc32(t.encode()) % self.about["buckets"] for t in terms})]
            paths = [p for p in paths if self.files.exists(p)]
            if paths:
                part = self.spark.read.schema(schema).option("basePath", root).parquet(*paths).select(*[x.split()[0] for x in schema.split(", ")])
                part = part if terms is None else part.where(F.col("term").isin(terms))
                out = part if out is None else out.unionByName(part)
        return out if out is not None else self.spark.createDataFrame([], schema)

    def _commit(self, part: str, n: int, tokens: int) -> None:
        about = self.about
        made = about | {"version": about["version"] + 1, "parts": [*about["parts"], part], "totals": [about["totals"][0] + n, about["totals"][1] + tokens]}
        self.files.write_next(f"{self.path}/about", made)
        self.about = made

    def mark(self, of: str) -> None:
        """Remember which version of the texts this is the index of."""
        self.about = self.about | {"of": of}
        self.files.write_next(f"{self.path}/about", self.about)

    def _write_terms(self, terms: DataFrame, part: str) -> None:
        terms.withColumn("bucket", bucket(F.col("term"), self.about["buckets"])).repartition("bucket").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{self.path}/{part}/terms")

    def add(self, docs: DataFrame, id: str = "id", text: str = "text") -> None:
        """Texts are cut once; what is written is counted from the files. Ids that are there must be removed first."""
        part, version = f"part-{uuid.uuid4().hex[:12]}", self.about["version"]
        tf = keyword.term_frequencies(keyword.spread(docs), id, text).withColumn("v", F.lit(version))
        rows = tf.withColumn("bucket", bucket(F.col("term"), self.about["buckets"]))
        rows = rows.repartition("bucket", F.pmod(F.hash("id"), F.lit(DEALT))).sortWithinPartitions("bucket", "term", "id")
        rows.write.partitionBy("bucket").parquet(f"{self.path}/{part}/postings")
        written = self.spark.read.schema("term string, id long, tf long, dl long").parquet(f"{self.path}/{part}/postings")
        self._write_terms(written.groupBy("term").agg(F.count("*").alias("df")), part)
        sizes = written.groupBy("id").agg(F.first("dl").alias("dl"))
        n, tokens = sizes.agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
        self._commit(part, n, tokens)

    def remove(self, ids: DataFrame) -> None:
        """Hide the postings of ids (column id) and take them off the counts."""
        part, version = f"part-{uuid.uuid4().hex[:12]}", self.about["version"]
        ids = ids.select(F.col("id").cast("long").alias("id")).distinct()
        gone = self._postings().join(ids, "id", "left_semi")
        self._write_terms(gone.groupBy("term").agg((-F.count("*")).alias("df")), part)
        n, tokens = gone.groupBy("id").agg(F.first("dl").alias("dl")).agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
        ids.withColumn("v", F.lit(version)).write.parquet(f"{self.path}/{part}/removed")
        self._commit(part, -n, -tokens)

    def upsert(self, docs: DataFrame, id: str = "id", text: str = "text") -> None:
        self.remove(docs.select(F.col(id).alias("id")))
        self.add(docs, id, text)

    # Reading.

    @property
    def count(self) -> int:
        """Documents with tokens."""
        return self.about["totals"][0]

    @property
    def average_length(self) -> float:
        n, tokens = self.about["totals"]
        return tokens / n if n else 0.0

    def _postings(self, terms: list[str] | None = None) -> DataFrame:
        rows = self._read("postings", "term string, id long, tf long, dl long, v int", terms)
        if any(self.files.exists(f"{self.path}/{p}/removed") for p in self.about["parts"]):
            gone = self._read("removed", "id long, v int").groupBy("id").agg(F.max("v").alias("gone"))
            rows = rows.join(gone, "id", "left").where("gone is null or v > gone")
        return rows.select("id", "term", "tf", "dl")

    def terms(self) -> DataFrame:
        """term, df of all terms."""
        return self._read("terms", NUMBERS).groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")

    def frequencies(self, terms: list[str]) -> dict[str, int]:
        """In how many documents each of the terms is; one row a term comes to the driver."""
        found = self._read("terms", NUMBERS, terms).groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
        return {r.term: r.df for r in found.collect()}

    def weights(self, query: str) -> dict[str, float]:
        """The query's known terms with idf * tf."""
        counts = Counter(tokenize_one(query))
        return {t: i * counts[t] for t, i in self._idf(list(counts)).items() if i > 0}

    def _idf(self, terms: list[str]) -> dict[str, float]:
        return {t: math.log((self.count - d + 0.5) / (d + 0.5) + 1) for t, d in self.frequencies(terms).items()}

    def postings(self, query: str, k1: float = keyword.K1, b: float = keyword.B) -> tuple[DataFrame, dict[str, float]]:
        """Postings (id, dim, w) of the query's terms, and the query's weights; as keyword.query_postings, without the texts."""
        counts = Counter(tokenize_one(query))
        idfs = self._idf(list(counts))
        rows = self._postings(list(idfs))
        if not idfs:
            return rows.select("id", F.col("term").alias("dim"), F.lit(0.0).alias("w")), {}
        by_term = F.create_map(*[F.lit(x) for pair in idfs.items() for x in pair])
        w = keyword.weight(by_term[F.col("term")], F.col("tf"), F.col("dl"), F.lit(self.average_length), k1, b)
        return rows.select("id", F.col("term").alias("dim"), w.alias("w")).where("w > 0"), {t: i * counts[t] for t, i in idfs.items() if i > 0}

    def top(self, query: str, k: int) -> DataFrame:
        """id, score by BM25."""
        found, words = self.postings(query)
        return keyword.sparse_top(found, words, k)

    def counts(self, terms: list[str]) -> DataFrame:
        """id, dim, w: how often each term is in each document that has it, as sparse vectors."""
        return self._postings(terms).select("id", F.col("term").alias("dim"), F.col("tf").cast("double").alias("w"))
