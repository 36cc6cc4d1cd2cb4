import numpy as np
import pytest
from pyspark.sql import functions as F

from vecframe import errors
from vecframe.operators import cluster, fusion, hnsw, indexes, keyword, links, search
from vecframe.plans import queries

RNG = np.random.default_rng(42)
X = RNG.standard_normal((600, 32)).astype(np.float32)
ASKED = RNG.standard_normal((12, 32)).astype(np.float32)


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(X)], "id long, vec array<float>").persist()
    df.count()
    return df


def truth(q, k, metric="l2", x=X):
    x, q = x.astype(float), q.astype(float)
    d = {"l2": np.sqrt(((x - q) ** 2).sum(1)), "cosine": 1 - x @ q / np.linalg.norm(x, axis=1) / np.linalg.norm(q), "dot_product": -x @ q}[metric]
    order = np.lexsort((np.arange(len(x)), d))[:k]
    return [(int(i), float(d[i])) for i in order]


@pytest.mark.parametrize("metric", ["l2", "cosine", "dot_product"])
def test_knn_and_batches_equal_numpy(spark, rows, metric):
    got = [(r.id, r.distance) for r in search.knn(rows, ASKED[0].tolist(), 7, metric).collect()]
    assert [g[0] for g in got] == [t[0] for t in truth(ASKED[0], 7, metric)] and [g[1] for g in got] == pytest.approx([t[1] for t in truth(ASKED[0], 7, metric)])
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(ASKED)], "qid long, qvec array<float>")
    for f in (search.knn_batch, search.knn_batch_columns):
        found = {}
        for r in f(rows, q, 5, metric).orderBy("qid", "rank").collect():
            found.setdefault(r.qid, []).append(r.id)
        assert found == {i: [t[0] for t in truth(v, 5, metric)] for i, v in enumerate(ASKED)}


def test_blocks_of_queries(spark, rows, monkeypatch):
    monkeypatch.setattr(search, "BLOCK_VALUES", 5 * 32)
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(ASKED)], "qid long, qvec array<float>")
    assert search.knn_batch(rows, q, 3).count() == 36


def test_edges(spark, rows):
    assert search.knn(rows, ASKED[0].tolist(), 0).count() == 0
    assert search.knn(rows, ASKED[0].tolist(), 10_000).count() == 600
    assert search.knn(rows.limit(0), ASKED[0].tolist(), 3).count() == 0
    ties = spark.createDataFrame([(i, [1.0, 0.0]) for i in (5, 3, 9, 1)], "id long, vec array<float>")
    assert [r.id for r in search.knn(ties, [0.0, 0.0], 3).collect()] == [1, 3, 5]
    q = spark.createDataFrame([], "qid long, qvec array<float>")
    assert search.knn_batch(rows, q, 3).count() == 0


def test_filters_exact_and_overscan(rows):
    from pyspark.sql import functions as F

    exact = search.knn(rows, ASKED[0].tolist(), 5, where=F.col("id") % 100 == 0)
    assert exact.count() == 5
    over = search.knn(rows, ASKED[0].tolist(), 5, where=F.col("id") % 100 == 0, mode="overscan").collect()
    assert [r.id for r in over] == [i for i, _ in truth(ASKED[0], 50) if i % 100 == 0][:5]


def recall_of(f, k=10):
    return np.mean([len({r.id for r in f(q.tolist()).collect()} & {i for i, _ in truth(q, k)}) / k for q in ASKED[:5]])


def test_quantised_recall(rows):
    assert recall_of(lambda q: search.knn_int8(rows, q, 10)) >= 0.95
    assert recall_of(lambda q: search.knn_fp16(rows, q, 10)) >= 0.98
    assert recall_of(lambda q: search.rerank(search.knn_binary(rows, q, 300), rows, q, 10)) >= 0.8


def test_ivf_and_pq(rows):
    centroids = cluster.kmeans(rows, 12, passes=5)
    lists = cluster.assign(rows, centroids)
    assert recall_of(lambda q: cluster.ivf_search(lists, centroids, q, 10, 12)) == 1
    assert recall_of(lambda q: cluster.ivf_search(lists, centroids, q, 10, 4)) >= 0.5
    book = cluster.pq_train(rows, 8, 32, 5)
    assert recall_of(lambda q: cluster.pq_search(cluster.pq_encode(rows, book), book, q, 10)) >= 0.3
    book = cluster.pq_train(cluster.residuals(rows, centroids), 8, 32, 5)
    assert recall_of(lambda q: cluster.ivfpq_search(cluster.ivfpq_encode(rows, centroids, book), centroids, book, q, 10, 12)) >= 0.3
    with pytest.raises(errors.InvalidConfig):
        cluster.pq_train(rows, 7)


def test_kmeans_equals_numpy(rows):
    now = X[:8].astype(float)
    near = ((X[:, None].astype(float) - now[None]) ** 2).sum(2).argmin(1)
    want = np.array([X[near == c].astype(float).mean(0) if (near == c).any() else now[c] for c in range(8)])
    assert np.allclose(cluster.kmeans_step(rows, now), want)
    assert len(cluster.kmeans(rows.limit(3), 8, passes=2)) == 3


def test_hnsw(spark, rows):
    graph = hnsw.build(rows, m=16, shards=3).persist()
    asked = [(i, q.tolist()) for i, q in enumerate(ASKED)]
    found = {}
    for r in hnsw.search(graph, asked, 10).collect():
        found.setdefault(r.qid, set()).add(r.id)
    assert np.mean([len(found[i] & {t for t, _ in truth(q, 10)}) / 10 for i, q in enumerate(ASKED)]) >= 0.94
    gone = spark.createDataFrame([(next(iter(found[0])),)], "id long")
    assert hnsw.search(graph, asked[:1], 10, deleted=gone).join(gone, "id").count() == 0
    assert hnsw.edges(graph).where("id = neighbour").count() == 0


def test_hnsw_keeps_k_when_the_nearest_are_deleted(spark, rows):
    graph = hnsw.build(rows, m=8, shards=2).persist()
    asked = [(i, q.tolist()) for i, q in enumerate(ASKED[:3])]
    gone = spark.createDataFrame([(i,) for i, _ in truth(ASKED[0], 120)], "id long")
    found = [r for r in hnsw.search(graph, asked, 10, ef_search=20, deleted=gone).collect() if r.qid == 0]
    assert len(found) == 10 and not {r.id for r in found} & {i for i, _ in truth(ASKED[0], 120)}


def test_hnsw_reaches_every_part(spark):
    """Groups of equal vectors that links don't connect, and empty and tiny tables."""
    x = np.repeat(np.random.default_rng(5).standard_normal((30, 8)), 60, axis=0)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    graph = hnsw.build(df, m=4, shards=1).persist()
    for g in range(0, 30, 7):
        found = hnsw.search(graph, [(0, x[60 * g].tolist())], 5).collect()
        assert [r.id for r in sorted(found, key=lambda r: r["rank"])] and all(r.distance < 1e-6 and r.id // 60 == g for r in found)
    for n in (0, 1, 2, 3):
        few = hnsw.build(df.where(f"id < {n}"), m=4)
        assert hnsw.search(few, [(0, x[0].tolist())], 5).count() == n


@pytest.mark.parametrize("kind", sorted(indexes.BY_KIND))
@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_index_classes(spark, tmp_path, kind, metric):
    options = {"n_lists": 4, "nprobe": 4, "pq_m": 2, "pq_k_sub": 8} if kind.startswith("ivf") else {}
    index = indexes.BY_KIND[kind](spark, 4, metric, **options)
    assert index.search([1, 0, 0, 0], 3) == []
    index.add(1, [1, 0, 0, 0])
    index.add_batch([(2, [0, 1, 0, 0]), (3, [0, 0, 1, 0])])
    index.add_batch_np(np.eye(4, dtype=np.float32)[3:], start_id=4)
    assert len(index) == 4
    index.flush()
    if kind != "binary_flat":
        assert index.search([1, 0, 0, 0], 1)[0]["id"] == 1
    with pytest.raises(ValueError):
        index.search([1, 0], 1)
    with pytest.raises(ValueError):
        index.add(9, [1.0])
    if index.strict:
        with pytest.raises(KeyError):
            index.add(1, [1, 0, 0, 0])
    else:
        index.add(1, [1, 0, 0, 0])
        assert len(index) == 4
    assert index.delete(2) and not index.delete(2) and len(index) == 3
    index.save(str(tmp_path / "i"))
    again = indexes.FlatIndex.load(spark, str(tmp_path / "i"))
    assert type(again) is type(index) and {i for i, _ in again} == {1, 3, 4}


def test_sparse(spark):
    p = spark.createDataFrame([(1, 0, 1.0), (1, 1, 0.5), (1, 2, 0.3), (2, 0, 0.2), (2, 3, 0.8), (3, 1, 0.9), (3, 2, 0.1), (3, 3, 0.7)], "id long, dim long, w double")
    assert [(r.id, pytest.approx(r.score)) for r in keyword.sparse_top(p, {0: 1.0, 1: 1.0}, 5).collect()] == [(1, 1.5), (3, 0.9), (2, 0.2)]
    assert keyword.sparse_top(p, {}, 5).count() == 0 and keyword.sparse_top(p, {0: 1.0}, 0).count() == 0


def test_equal_sparse_vectors_tie_by_id(spark):
    """0.1 + 0.2 + 0.3 is more than 0.3 + 0.2 + 0.1 in doubles; copies whose rows come in another order score the same."""
    rows = [(2, 0, 0.1), (2, 1, 0.2), (2, 2, 0.3), (1, 2, 0.3), (1, 1, 0.2), (1, 0, 0.1)]
    p = spark.createDataFrame(rows, "id long, dim long, w double").coalesce(1)
    found = keyword.sparse_top(p, {0: 1.0, 1: 1.0, 2: 1.0}, 2).collect()
    assert [r.id for r in found] == [1, 2] and found[0].score == found[1].score


def test_sparse_links_in_blocks(spark, monkeypatch):
    """Copies, vectors without links and several blocks, against all pairs."""
    monkeypatch.setattr(keyword, "LINK_BLOCK", 20)
    rng = np.random.default_rng(5)
    made = {i: {int(d): float(rng.integers(1, 4)) for d in rng.integers(0, 60, 3)} for i in range(60)}
    made |= {100 + i: made[i] for i in range(5)} | {200 + i: {0: 1.0} for i in range(50)} | {300: {999: 2.0}}
    p = spark.createDataFrame([(i, str(d), w) for i, v in made.items() for d, w in v.items()], "id long, dim string, w double")
    want = {}
    for i, v in made.items():
        dots = {j: sum(w * u[d] for d, w in v.items() if d in u) for j, u in made.items() if v.keys() & u.keys()}
        want[i] = (min(j for j, u in made.items() if u == v), len(dots) - 1, sum(dots.values()))
    assert {r.id: (r.class_id, r.links, r.dot) for r in keyword.sparse_links(p).collect()} == want


def test_sparse_links_from_the_shorter_side(spark, monkeypatch):
    """Kinds and lengths in many blocks, dimensions as bits and as lists, copies on both sides, names of more than a byte."""
    monkeypatch.setattr(keyword, "LINK_BLOCK", 30)
    monkeypatch.setattr(keyword, "LINK_SHARE", 4)
    monkeypatch.setattr(links, "SEEN", 2)
    rng = np.random.default_rng(6)
    made = {}
    for i in range(240):
        low = 100 * (i % 3)
        made[i] = {f"é{d}": 1.0 for d in (low + 99 * rng.random(1 + i // 8) ** 3).astype(int).tolist()} | ({"all": 2.0} if i % 10 == 0 else {})
    made |= {1000 + i: made[i // 3] for i in range(60)} | {2000: {"own": 3.0}}
    p = spark.createDataFrame([(i, d, w) for i, v in made.items() for d, w in v.items()], "id long, dim string, w double")
    want = {}
    for i, v in made.items():
        dots = [sum(w * u[d] for d, w in v.items() if d in u) for u in made.values() if v.keys() & u.keys()]
        want[i] = (min(j for j, u in made.items() if u == v), len(dots) - 1, sum(dots))
    assert {r.id: (r.class_id, r.links, r.dot) for r in keyword.sparse_links(p).collect()} == want


def test_unions_of_a_block():
    """Each way of a union, and sums of rows and columns with copies, against plain sets."""
    rng = np.random.default_rng(7)
    sets = [np.unique((300 * rng.random(rng.integers(0, 260)) ** 2).astype(np.int32)) for _ in range(150)]
    flat, lengths, n = np.concatenate(sets), np.array([len(x) for x in sets]), rng.integers(1, 6, 150)
    want = np.array([[len(np.intersect1d(a, b)) > 0 for b in sets] for a in sets])
    for share in (1, 5, 1000):
        held = links.Held(flat, lengths, n, 300, share)
        union = held.union(flat, lengths)
        assert (np.unpackbits(union.view(np.uint8), axis=1, bitorder="little")[:, :150] == want).all()
        assert (held.across(union) == want @ n).all() and (held.down(union, n)[:150] == n @ want).all()


def test_documents_are_linked_as_their_terms(spark, monkeypatch):
    """Counted where they are cut: no text, no terms, capitals, other letters; and an id in two rows is one vector."""
    texts = [None, "", "the a I", "Fox fox dog", "fox FOX dog!", "Élan dog-cat", "K2 k9", "9k cat_dog ünder", "zebra", "dog\nfox\tfox"]
    for rows in ([*enumerate(texts)], [*enumerate(texts), (3, "zebra fox")]):
        docs = spark.createDataFrame(rows, "id long, text string")
        terms = keyword.term_frequencies(docs).select("id", F.col("term").alias("dim"), F.col("tf").alias("w"))
        got, want = keyword.document_links(docs).collect(), keyword.sparse_links(terms).collect()
        assert sorted(got) == sorted(want) and {r.id for r in got} == set(range(3, 10))


def test_bm25_batch_and_one_by_one(spark):
    docs = [(1, "the quick brown fox"), (2, "lazy dog sleeps near brown bear"), (3, ""), (4, "fox fox dog")]
    one = keyword.BM25()
    got = {i: one.index_document(i, t) for i, t in docs}
    assert got[3] == {} and one.doc_count == 3 and one.avg_dl == pytest.approx((3 + 6 + 3) / 3)
    names = {v: k for k, v in one.terms.items()}
    want = {(i, names[d]): w for i, x in got.items() for d, w in x.items()}
    df = spark.createDataFrame(docs, "id long, text string")
    found = {(r.id, r.term): r.w for r in keyword.bm25_weights_as_of_insert(df).collect()}
    assert found == pytest.approx(want)
    assert keyword.bm25_top(df, "fox", 1).first().id == 4 and keyword.query_weights(keyword.term_frequencies(df), "unknown words") == {}


def test_bm25_saves(tmp_path):
    one = keyword.BM25()
    one.index_document(1, "red green blue")
    one.save(str(tmp_path / "b"))
    two = keyword.BM25.load(str(tmp_path / "b"))
    assert two.encode_query("green") == one.encode_query("green") and two.vocab_size == 3
    two.remove_document(1)
    assert two.doc_count == 0 and two.avg_dl == 0


def test_fusion(spark):
    dense = spark.createDataFrame([(1, 0.0), (2, 1.0)], "id long, distance double")
    sparse = spark.createDataFrame([(2, 2.0), (3, 1.0)], "id long, score double")
    got = {r.id: r.score for r in fusion.fuse(dense, sparse, 5, 0.5, 0.5).collect()}
    assert got == pytest.approx({1: 0.5 + 0.5 * -1, 2: 0.5, 3: 0.0})
    assert {r.id for r in fusion.fuse(dense, sparse, 5, allowed=dense.where("id = 2")).collect()} == {2}
    assert fusion.fuse(dense.limit(0), sparse.limit(0), 5).count() == 0
    clipped = {r.id: r.score for r in fusion.fuse(dense, sparse, 5, 0.5, 0.5, clip=True).collect()}
    assert clipped[1] == pytest.approx(0.5)


def test_fusion_of_spaces(spark):
    a = spark.createDataFrame([(1, 0.0), (2, 1.0), (3, 0.1)], "id long, distance double")
    b = spark.createDataFrame([(2, 0.0), (1, 1.0), (3, 0.1)], "id long, distance double")
    got = fusion.fuse_spaces({"a": a, "b": b}, 3).collect()
    assert got[0].id == 3 and got[0].score == pytest.approx(0.9) and got[0].distances == {"a": 0.1, "b": 0.1}
    only = fusion.fuse_spaces({"a": a, "b": b.limit(0)}, 3, {"a": 1.0, "b": 3.0}).first()
    assert only.id == 1 and only.score == pytest.approx(0.25)


def test_batches_rank_copies_by_id(spark):
    """Each row is there twice; the last bits of a product must not decide which comes first."""
    x = np.random.default_rng(3).normal(size=(1500, 64)).astype(np.float32).astype(float)
    df = spark.createDataFrame([(i, x[i % 1500].tolist()) for i in range(3000)], "id long, vec array<double>")
    for n in (15, 300):  # rows and queries go to the tasks
        asked = df.where(f"id < {n}").select(df.id.alias("qid"), df.vec.alias("qvec"))
        for metric in ("l2", "cosine", "dot_product"):
            found = [(r.qid, r["rank"], r.id, r.distance) for r in search.knn_batch(df, asked, 20, metric).orderBy("qid", "rank").collect()]
            assert len(found) == 20 * n
            for a, b in zip(found[::2], found[1::2], strict=True):
                assert b[2] == a[2] + 1500 and b[3] == a[3]


def copies_and_others(spark, metric, m):
    """1500 equal rows and 500 others, their graph (from many copies links lead to few), and queries of both kinds."""
    x = np.random.default_rng(1).normal(size=(2000, 32))
    x[:1500] = x[0]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    return df, hnsw.build(df, metric, m=m, shards=1), df.where("id % 100 = 0").select(df.id.alias("qid"), df.vec.alias("qvec"))


def as_rows(found):
    return sorted((r.qid, r["rank"], r.id) for r in found.collect())


def test_beam_of_all_rows_is_exact_among_copies(spark):
    df, graph, asked = copies_and_others(spark, "l2", 4)
    assert as_rows(hnsw.search_frame(graph, asked, 10, ef_search=2000)) == as_rows(search.knn_batch(df, asked, 10))


def test_beam_of_all_rows_is_exact_by_angle(spark):
    df, graph, asked = copies_and_others(spark, "cosine", 4)
    assert as_rows(hnsw.search_frame(graph, asked, 10, "cosine", ef_search=2000)) == as_rows(search.knn_batch(df, asked, 10, "cosine"))


def test_beam_of_half_the_rows_is_exact_without_deleted(spark):
    df, graph, asked = copies_and_others(spark, "l2", 4)
    gone = df.where("id % 3 = 0").select("id")
    found = hnsw.search_frame(graph, asked, 10, ef_search=1000, deleted=gone)
    assert as_rows(found) == as_rows(search.knn_batch(df.where("id % 3 <> 0"), asked, 10))


def test_large_shards_are_divided(spark, monkeypatch):
    """A shard's graph is made of all pairs of its rows, so few shards of many rows never end."""
    df, *_ = copies_and_others(spark, "l2", 4)
    monkeypatch.setattr(hnsw, "SHARD_ROWS", 300)
    graph = hnsw.build(df, shards=2).persist()
    assert [r.shards for r in graph.select("shards").collect()] == [7] * 7 and hnsw.rows(graph).count() == 2000
    asked = df.where("id % 100 = 0").select(df.id.alias("qid"), df.vec.alias("qvec"))
    assert as_rows(hnsw.search_frame(graph, asked, 10, ef_search=2000)) == as_rows(search.knn_batch(df, asked, 10))


@pytest.mark.parametrize("metric", ["l2", "cosine", "dot_product"])
def test_products_in_single_precision_lose_no_row(metric):
    """Copies, rows that differ by less than single precision tells, zeros, odd sizes; and values that are no numbers or too large for it."""
    g = np.random.default_rng(7)
    x = g.normal(size=(5003, 16))
    x[1000:2000], x[2000:2500], x[2500:2520] = x[:1000], x[3] + 1e-9 * g.normal(size=(500, 16)), 0
    ids = g.permutation(5003)
    for odd in (1.0, np.nan, 1e200):
        x[4000, 0] *= odd
        q = x[[3, 7, 2500, 5002, *range(200, 400), *([4000] if odd == 1.0 else [])]]
        with np.errstate(all="ignore"):
            found, wanted = search.closest_of_many(metric, x, ids, q, 10), search.closest(metric, x, ids, q, 10)
        assert all(np.array_equal(a, b) for a, b in zip(found, wanted, strict=True))
        x[4000, 0] = 1.0


def test_links_are_the_nearest(monkeypatch):
    """Groups of values give the same least ones as all values do."""
    d = np.random.default_rng(2).normal(size=(40, 7001)).astype(np.float32)
    d[:, 5000:5600] = d[:, :600]
    near, value = hnsw._least(d, 96)
    assert np.array_equal(value, np.sort(d, axis=1)[:, :96]) and np.array_equal(np.take_along_axis(d, near, 1), value)
    assert all(len(set(row)) == 96 for row in near.tolist())


def test_many_queries_meet_by_query(spark):
    df, graph, _ = copies_and_others(spark, "l2", 4)
    asked = df.where("id >= 700").select(df.id.alias("qid"), df.vec.alias("qvec"))
    assert asked.count() > search.FEW
    shards = hnsw.build(df, m=4, shards=3)
    assert as_rows(hnsw.search_frame(shards, asked, 10, ef_search=2000)) == as_rows(search.knn_batch(df, asked, 10))


def test_many_queries_meet_by_query_by_angle(spark, monkeypatch):
    monkeypatch.setattr(hnsw, "SHARD_ROWS", 700)
    df, *_ = copies_and_others(spark, "cosine", 4)
    asked = df.where("id >= 700").select(df.id.alias("qid"), df.vec.alias("qvec"))
    shards = hnsw.build(df, "cosine", m=4, shards=2).persist()
    assert shards.count() == 3
    assert as_rows(hnsw.search_frame(shards, asked, 10, "cosine", ef_search=2000)) == as_rows(search.knn_batch(df, asked, 10, "cosine"))


def test_shards_are_dealt_evenly(spark, monkeypatch):
    """A graph takes its task seconds, so no task gets a second shard before each has one."""
    from pyspark.sql import functions as F

    df, *_ = copies_and_others(spark, "cosine", 4)
    tasks = lambda: sorted(r["count"] for r in hnsw.build(df, "cosine", m=4, shards=7).groupBy(F.spark_partition_id()).count().collect())
    assert tasks() == [1] * 7
    monkeypatch.setattr(hnsw, "TASKS", 0)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        assert tasks() == [2, 2, 3]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("metric", ["l2", "cosine", "dot_product"])
def test_results_kept_from_shard_to_shard(spark, monkeypatch, metric):
    """A task's shards give k rows a query together, ties by id included, and the same rows as each on its own."""
    df, *_ = copies_and_others(spark, metric, 4)
    asked = df.where("id >= 700").select(df.id.alias("qid"), df.vec.alias("qvec"))
    shards, sizes, packed = hnsw.build(df, metric, m=4, shards=5).coalesce(1).persist(), [], hnsw.merged
    monkeypatch.setattr(hnsw, "merged", lambda found, *a: (sizes.append(found.selectExpr("sum(size(id))").first()[0]), packed(found, *a))[1])
    wanted = as_rows(search.knn_batch(df, asked, 10, metric))
    assert as_rows(hnsw.search_frame(shards, asked, 10, metric, ef_search=2000)) == wanted
    monkeypatch.setattr(hnsw, "KEPT", 0)
    assert as_rows(hnsw.search_frame(shards, asked, 10, metric, ef_search=2000)) == wanted
    assert sizes == [10 * asked.count(), 50 * asked.count()]


@pytest.mark.parametrize("metric", ["l2", "cosine", "dot_product"])
def test_bounds_lose_no_row(metric):
    g = np.random.default_rng(8)
    x, ids = g.normal(size=(4003, 16)), g.permutation(4003)
    x[1000:2000], x[2500:2520] = x[:1000], 0
    q = x[[3, 2500, *range(200, 300)]]
    wanted = search.closest(metric, x, ids, q, 10)
    half = search.closest(metric, x[:2000], ids[:2000], q, 10)
    more = search.closest_of_many(metric, x[2000:], ids[2000:], q, 10, search.bounds(half, len(q), 10))
    found = search.least(*[np.concatenate(z) for z in zip(half, more, strict=True)], 10)
    assert all(np.array_equal(a, b) for a, b in zip(found, wanted, strict=True)) and len(more[0]) < len(wanted[0])


def test_deleted_ids_need_no_second_build(spark, monkeypatch):
    """The rows are read once for a search, and ids that are too many to go to all tasks are left out too."""
    df, graph, asked = copies_and_others(spark, "l2", 4)
    gone, read = df.where("id % 3 = 0").select("id"), spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    index = hnsw.build(df.mapInArrow(counted, df.schema), m=4, shards=3)
    before, wanted = read.value, as_rows(search.knn_batch(df.where("id % 3 <> 0"), asked, 10))
    assert as_rows(hnsw.search(index, [(r.qid, r.qvec) for r in asked.collect()], 10, ef_search=1000, deleted=gone)) == wanted
    assert read.value - before == 2000
    monkeypatch.setattr(hnsw, "GONE", 100)
    assert as_rows(hnsw.search_frame(graph, asked, 10, ef_search=1000, deleted=gone)) == wanted


def test_factory_strings(spark):
    kinds = {"Flat": "FlatIndex", "SQ8": "QuantizedFlatIndex", "HNSW16": "HnswIndex", "IVF4,Flat": "IvfIndex", "IVF4,PQ2x4": "IvfPqIndex"}
    assert {f: type(indexes.from_factory(spark, 4, f)).__name__ for f in kinds} == kinds
    assert indexes.from_factory(spark, 4, "IVF4,PQ2x4").options == {"n_lists": 4, "pq_m": 2, "pq_k_sub": 16}
    for bad in ("LSH", "IVF4,PQ2x12", ""):
        with pytest.raises(ValueError):
            indexes.from_factory(spark, 4, bad)


def test_sparse_index(spark):
    index = indexes.SparseIndex(spark)
    assert len(index) == 0 and index.search({1: 1.0}, 3) == []
    index.upsert_batch([(1, {0: 1.0, 1: 0.5}), (2, {0: 0.2, 3: 0.8})])
    index.upsert(1, {3: 0.5})
    assert index.search({0: 1.0, 3: 1.0}, 5) == [{"id": 2, "score": pytest.approx(1.0)}, {"id": 1, "score": 0.5}]
    assert 1 in index and index.get(1) == {3: 0.5} and index.delete(1) and not index.delete(1) and [i for i, _ in index] == [2]


@pytest.mark.parametrize("name", ["ivf", "pq", "ivfpq"])
def test_recall_of_trained_indexes(spark, name):
    """Over all queries whose id is divisible by 100, none of which is a centroid by choice."""
    found = {r.qid: r.recall for r in queries.QUERIES[f"{name}_trained_recall"](spark, "/root/testdata/sf0.1").collect()}
    ids = [r.vec_id for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").where("vec_id % 100 = 0").collect()]
    assert sorted(found) == sorted(ids) and np.mean(list(found.values())) >= 0.9


def test_hybrid_with_a_selective_filter(spark):
    """All 5 rows that match come, though they are among the farthest and lowest scored of 300."""
    made = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(300)], "id long, vec array<double>")
    postings = spark.createDataFrame([(i, 7, float(300 - i)) for i in range(300)], "id long, dim long, w double")
    ask = lambda mode: [r.id for r in fusion.hybrid(made, postings, [0.0, 0.0], {7: 1.0}, 5, where=made.id >= 295, mode=mode).collect()]
    assert ask("exact") == [295, 296, 297, 298, 299] and ask("overscan") == []
