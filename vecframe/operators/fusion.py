"""Weighted fusion of rankings by min-max normalised scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .keyword import sparse_top
from .search import OVERSCAN, knn

LEAST_RANGE = 1e-9
DENSE_WEIGHT, SPARSE_WEIGHT = 0.7, 0.3


def fuse(dense: DataFrame, sparse: DataFrame, k: int, dense_weight: float = DENSE_WEIGHT, sparse_weight: float = SPARSE_WEIGHT, allowed: DataFrame | None = None, clip: bool = False) -> DataFrame:
    """id, score, dense_distance, sparse_score from candidates dense (id, distance) and sparse (id, score).

    Both sides are scaled by their range over all candidates, before ``allowed`` (ids) filters them; an id that one
    side lacks gets its largest distance, or score 0. clip keeps the scaled parts within 0 and 1.
    """
    edges = dense.agg(F.coalesce(F.min("distance"), F.lit(0.0)).alias("dmin"), F.coalesce(F.max("distance"), F.lit(1.0)).alias("dmax"))
    edges = edges.crossJoin(sparse.agg(F.coalesce(F.min("score"), F.lit(0.0)).alias("smin"), F.coalesce(F.max("score"), F.lit(1.0)).alias("smax")))
    both = dense.select("id", F.col("distance").alias("dense_distance")).join(sparse.select("id", F.col("score").alias("sparse_score")), "id", "full")
    if allowed is not None:
        both = both.join(allowed.select("id"), "id", "left_semi")
    near = 1 - (F.coalesce("dense_distance", "dmax") - F.col("dmin")) / F.greatest(F.col("dmax") - F.col("dmin"), F.lit(LEAST_RANGE))
    word = (F.coalesce("sparse_score", F.lit(0.0)) - F.col("smin")) / F.greatest(F.col("smax") - F.col("smin"), F.lit(LEAST_RANGE))
    if clip:
        near, word = (F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)) for x in (near, word))
    scored = both.crossJoin(F.broadcast(edges)).withColumn("score", F.lit(float(dense_weight)) * near + F.lit(float(sparse_weight)) * word)
    return scored.select("id", "score", "dense_distance", "sparse_score").orderBy(F.desc("score"), "id").limit(max(0, k))


def hybrid(rows: DataFrame, postings: DataFrame, query: Sequence[float], sparse_query: dict, k: int, metric: str = "l2", dense_weight: float = DENSE_WEIGHT, sparse_weight: float = SPARSE_WEIGHT, where: Column | None = None, clip: bool = False, mode: str = "exact") -> DataFrame:
    """Fusion of the nearest and the best-scored OVERSCAN * k of rows (id, vec) and postings (id, dim, w).

    where restricts the candidates. mode "exact" filters both sides first, so k come if there are k; "overscan" filters
    the candidates of all rows, so it may return fewer.
    """
    if where is not None and mode == "exact":
        rows, where = rows.where(where), None
        postings = postings.join(rows.select("id"), "id", "left_semi")
    dense = knn(rows, query, OVERSCAN * k, metric)
    sparse = sparse_top(postings, sparse_query, OVERSCAN * k)
    return fuse(dense, sparse, k, dense_weight, sparse_weight, rows.where(where).select("id") if where is not None else None, clip)


def fuse_spaces(candidates: dict[str, DataFrame], k: int, weights: dict[str, float] | None = None) -> DataFrame:
    """id, score, distances (a map by space) from each space's candidates (id, distance).

    Weights are divided by their sum over the spaces queried; a space that lacks an id adds nothing.
    """
    weights = {s: float((weights or {}).get(s, 1.0 if weights is None else 0.0)) for s in candidates}
    total = sum(weights.values())
    total = total if total > 0 else 1.0
    parts = None
    for space in sorted(candidates):
        part = candidates[space].select("id", "distance", F.lit(space).alias("space"), F.lit(weights[space] / total).alias("w"))
        parts = part if parts is None else parts.unionByName(part)
    own = Window.partitionBy("space")
    spread = F.max("distance").over(own) - F.min("distance").over(own)
    scaled = F.coalesce(F.try_divide(F.col("distance") - F.min("distance").over(own), spread), F.lit(0.0))
    scored = parts.withColumn("part", F.col("w") * (1 - scaled))
    out = scored.groupBy("id").agg(F.sum("part").alias("score"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("space", "distance")))).alias("distances"))
    return out.orderBy(F.desc("score"), "id").limit(max(0, k))


def space_overscan(k: int) -> int:
    return max(5 * k, 50)
