import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecframe import errors
from vecframe.functions import filters, metrics, quantize
from vecframe.functions.text import STOP_WORDS, tokenize, tokenize_one


def one(spark, *columns):
    return list(spark.range(1).select(*columns).first())


def vec(*x):
    return F.array(*[F.lit(float(v)) for v in x])


def test_distances(spark):
    a, b, zero = vec(1, 2, 3), vec(4, 6, 3), vec(0, 0, 0)
    got = one(spark, metrics.l2_squared(a, b), metrics.l2(a, b), metrics.dot(a, b), metrics.dot_distance(a, b), metrics.cosine_distance(a, b), metrics.cosine_distance(a, zero), metrics.cosine_distance(zero, zero))
    assert got == pytest.approx([25, 5, 25, -25, 1 - 25 / math.sqrt(14 * 61), 1, 1])


@pytest.mark.parametrize("metric", metrics.METRICS)
def test_ordering_and_query_forms_agree(spark, metric):
    a, b = vec(1, -2, 0.5), [0.25, 3, 1]
    true, order, fixed = one(spark, metrics.distance(metric, a, metrics.vector(b)), metrics.ordering_distance(metric, a, metrics.vector(b)), metrics.query_distance(metric, a, b))
    assert order == pytest.approx(fixed)
    assert true == pytest.approx(math.sqrt(order) if metric == "l2" else order)


def test_cosine_to_a_zero_query(spark):
    assert one(spark, metrics.query_distance("cosine", vec(1, 2), [0, 0])) == [1.0]


def test_sizes_must_agree(spark):
    with pytest.raises(Exception, match="dimension"):
        one(spark, metrics.distance("l2", vec(1), vec(1, 2)))
    with pytest.raises(errors.InvalidConfig):
        metrics.check_metric("manhattan")
    with pytest.raises(ValueError):
        metrics.check_dimensions([1, 2], 3)


def test_normalize(spark):
    unit, zero = one(spark, metrics.normalize(vec(3, 4)), metrics.normalize(vec(0, 0)))
    assert unit == pytest.approx([0.6, 0.8]) and zero == [0, 0]


def test_sql_functions(spark):
    metrics.register(spark)
    row = spark.sql("select vec_dot(array(1D, 2D), array(3D, 4D)), vec_l2(array(0D, 0D), array(3D, 4D)), vec_cosine_distance(array(0D), array(1D)), vec_norm(array(3D, 4D))").first()
    assert list(row) == [11, 5, 1, 5]


def test_int8(spark):
    codes, scale, zeros = one(spark, quantize.int8_encode(vec(1, -0.5, 0.25)), quantize.int8_scale(vec(1, -0.5, 0.25)), quantize.int8_encode(vec(0, 0)))
    assert codes == [127, -64, 32] and scale == pytest.approx(1 / 127) and zeros == [0, 0]


def test_fp16_equals_numpy(spark):
    x = np.concatenate([np.random.default_rng(0).standard_normal(200), [0, 1e-6, 6e-8, 2**-14, 65504, -0.333]]).astype(np.float32)
    assert one(spark, quantize.fp16_round(vec(*x)))[0] == x.astype(np.float16).astype(float).tolist()


def test_binary(spark):
    x = np.random.default_rng(1).standard_normal(100)
    y = np.random.default_rng(2).standard_normal(100)
    h, words, back = one(spark, metrics.hamming(quantize.binary_encode(vec(*x)), quantize.binary_encode(vec(*y))), quantize.binary_encode(vec(*x)), quantize.binary_decode(quantize.binary_encode(vec(*x)), 100, F.lit(10.0)))
    assert h == ((x >= 0) != (y >= 0)).sum() and len(words) == 2
    assert (np.sign(back) == np.where(x >= 0, 1, -1)).all() and np.linalg.norm(back) == pytest.approx(10)


ROWS = [(1, "tech", 4.8), (2, "science", 3.2), (3, "tech", 2.5), (4, "art", 4.1)]


@pytest.mark.parametrize(("spec", "ids"), [
    ({"cat": {"$eq": "tech"}}, {1, 3}), ({"score": {"$gte": 4.0}}, {1, 4}), ({"cat": {"$in": ["tech", "art"]}}, {1, 3, 4}), ({"$and": [{"cat": {"$eq": "tech"}}, {"score": {"$gte": 4}}]}, {1}),
    ({"$or": [{"cat": {"$eq": "art"}}, {"score": {"$gte": 4.5}}]}, {1, 4}), ({"cat": {"$ne": "tech"}}, {2, 4}), ({"no": {"$ne": 1}}, set()), ({"$and": []}, {1, 2, 3, 4}), ({"$or": []}, set()), ({"cat": {"$gt": 3}}, set()),
    ({"$and": [], "other": 3}, {1, 2, 3, 4}),
])
def test_filters_on_structs_and_json(spark, spec, ids):
    df = spark.createDataFrame(ROWS, "id long, cat string, score double").select("id", F.struct("cat", "score").alias("p"))
    typed = df.where(filters.compile_filter(spec, F.col("p"), df.schema["p"].dataType))
    text = df.select("id", F.to_json("p").alias("p")).where(filters.compile_filter(spec, F.col("p")))
    variant = df.select("id", F.parse_json(F.to_json("p")).alias("p"))
    variant = variant.where(filters.compile_filter(spec, F.col("p"), variant.schema["p"].dataType))
    assert all({r.id for r in x.collect()} == ids for x in (typed, text, variant))


@pytest.mark.parametrize("bad", [{}, {"a": 1}, {"a": {}}, {"a": {"$eq": 1, "$gt": 0}}, {"a": {"$eq": 1}, "b": {"$eq": 1}}, {"a": {"$regex": "x"}}, {"$and": 3}, {"a": {"$in": 3}}, [], None])
def test_bad_filters(bad):
    with pytest.raises(ValueError, match="invalid filter"):
        filters.validate(bad)


def test_pushed_filters_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame(ROWS, "id long, cat string, score double").select("id", F.struct("cat", "score").alias("p")).write.parquet(path)
    df = spark.read.parquet(path)
    plan = df.where(filters.compile_filter({"p": {"$eq": 1}}, F.col("p"), T.StructType())).count()
    text = df.where(F.col("p.score") > 4)._jdf.queryExecution().toString()
    assert plan == 0 and "PushedFilters" in text


def test_tokenizer(spark):
    for text in ("The quick, brown FOX-trot a b2 x!", "", "naïve café", "is the and"):
        assert one(spark, tokenize(F.lit(text)))[0] == tokenize_one(text)
    assert tokenize_one("The quick, brown FOX-trot a b2 x!") == ["quick", "brown", "fox", "trot", "b2"]
    assert one(spark, tokenize(F.lit(None).cast("string")))[0] == [] and "the" in STOP_WORDS
