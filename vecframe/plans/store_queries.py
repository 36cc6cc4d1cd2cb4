"""Registered queries through the public classes: indexes, graphs, collections, texts, spaces and requests.

Graphs and lists are asked with beams and probes that reach every row, so SQL can check what they return.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import cluster, hnsw, indexes, search
from ..sources.collections import MultiVectorCollection, TextCollection
from ..sources.embed import embed_column
from ..sources.server import respond
from ..sources.store import Client
from .queries import (
    ASK, C, E, K, NEAREST, ORACLE_SQL, PARTS, Q, SEEDS, TF, W, asked, asked_hundredth, documents, first, fixed, folder, query, r6, rounded, spaces_sql, sq, table, vectors,
)

KNN = f"with {E}, {Q} select id, round(list_distance(v, q), 6) as distance from (select * from e, q where {{}} order by list_distance(v, q), id limit {K})"
KNN_ALL = KNN.format("true")


def frame(spark, found: list[dict], ddl: str = "id long, distance double"):
    names = [x.split()[0] for x in ddl.split(", ")]
    return rounded(spark.createDataFrame([tuple(f[n] for n in names) for f in found], ddl), *[n for n in names if n != "id"])


def wide(e):
    """A beam that holds every row."""
    return max(1, e.count())


# Graphs.


@query("hnsw_exact", ORACLE_SQL["knn_hundredth_l2"])
def hnsw_exact(spark, sf_dir):
    e = vectors(spark, sf_dir)
    return rounded(hnsw.search_frame(hnsw.build(e, shards=4), asked_hundredth(e), K, ef_search=wide(e)), "distance")


@query("hnsw_exact_cosine", ORACLE_SQL["knn_hundredth_cosine"])
def hnsw_exact_cosine(spark, sf_dir):
    e = vectors(spark, sf_dir)
    return rounded(hnsw.search_frame(hnsw.build(e, "cosine", shards=2), asked_hundredth(e), K, "cosine", ef_search=wide(e)), "distance")


@query("hnsw_exact_without_deleted", ORACLE_SQL["knn_hundredth_l2"].replace("b.id % 100 = 0", "b.id % 100 = 0 and a.id % 3 <> 0"))
def hnsw_exact_without_deleted(spark, sf_dir):
    """A third of the rows is deleted, and the beam is narrower than they are."""
    e = vectors(spark, sf_dir)
    gone = e.where("id % 3 = 0").select("id")
    return rounded(hnsw.search_frame(hnsw.build(e, shards=4), asked_hundredth(e), K, ef_search=wide(e) // 8, deleted=gone), "distance")


@query("hnsw_saved_exact", KNN_ALL)
def hnsw_saved_exact(spark, sf_dir):
    """A graph that was written and read."""
    e, path = vectors(spark, sf_dir), folder(spark)
    hnsw.build(e, shards=3).write.parquet(path)
    return rounded(hnsw.search(spark.read.parquet(path), [(0, first(spark, sf_dir))], K, ef_search=wide(e)).select("id", "distance"), "distance")


@query("hnsw_rows", f"with {E} select id, round(list_sum(v), 4) as total from e")
def hnsw_rows(spark, sf_dir):
    """What a graph holds."""
    rows = hnsw.rows(hnsw.build(vectors(spark, sf_dir), shards=3))
    return rows.select("id", F.round(F.aggregate(F.col("vec").cast("array<double>"), F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


# Index classes.


@query("index_flat_knn", KNN_ALL)
def index_flat_knn(spark, sf_dir):
    """Rows added one by one, in batches, from a matrix and as a frame."""
    e, index = vectors(spark, sf_dir), indexes.FlatIndex(spark, 64)
    some = e.where("id < 60").orderBy("id").collect()
    index.add(some[0].id, some[0].vec)
    index.add_batch([(r.id, r.vec) for r in some[1:30]])
    index.add_batch_np(np.array([r.vec for r in some[30:]], np.float32), start_id=30)
    index.add_frame(e.where("id >= 60"))
    return rounded(index.search_frame(first(spark, sf_dir), K), "distance")


@query("index_iteration", f"with {E} select id, round(v[1], 6) as x from e where id % 5 <> 1")
def index_iteration(spark, sf_dir):
    """Deletes, then all rows one by one."""
    e, index = vectors(spark, sf_dir), indexes.QuantizedFlatIndex(spark, 64)
    index.add_frame(e.where("id % 5 <> 1 or id = 1"))
    assert index.delete(1) and not index.delete(1)
    return rounded(spark.createDataFrame([(i, float(v[0])) for i, v in index], "id long, x double"), "x")


@query("index_upsert_last_wins", f"with {E} select id, round(case when id % 2 = 0 then -v[1] else v[1] end, 6) as x from e")
def index_upsert_last_wins(spark, sf_dir):
    e, index = vectors(spark, sf_dir), indexes.Fp16FlatIndex(spark, 64)
    index.add_frame(e)
    index.add_frame(e.where("id % 2 = 0").select("id", F.transform("vec", lambda x: -x).alias("vec")))
    return rounded(index.rows().select("id", F.col("vec")[0].cast("double").alias("x")), "x")


@query("index_mmap_knn", KNN_ALL)
def index_mmap_knn(spark, sf_dir):
    """Searched from the files that flush writes."""
    index = indexes.MmapFlatIndex(spark, 64, path=folder(spark))
    index.add_frame(vectors(spark, sf_dir))
    index.flush()
    return rounded(index.search_frame(first(spark, sf_dir), K), "distance")


@query("index_save_load", KNN_ALL)
def index_save_load(spark, sf_dir):
    path, index = folder(spark), indexes.FlatIndex(spark, 64)
    index.add_frame(vectors(spark, sf_dir))
    index.save(path)
    return rounded(indexes.FlatIndex.load(spark, path).search_frame(first(spark, sf_dir), K), "distance")


def _factory(name: str, text: str, options: dict) -> None:
    @query(f"factory_{name}_knn", KNN_ALL)
    def run(spark, sf_dir):
        index = indexes.from_factory(spark, 64, text)
        index.options |= options
        index.add_frame(vectors(spark, sf_dir))
        index.flush()
        return rounded(index.search_frame(first(spark, sf_dir), K), "distance")


_factory("flat", "Flat", {})
_factory("ivf", "IVF16,Flat", {"nprobe": 16, "train_size": 1})
_factory("hnsw", "HNSW16", {"ef_search": 1_000_000})


@query("index_set_ef_search", KNN_ALL)
def index_set_ef_search(spark, sf_dir):
    e, index = vectors(spark, sf_dir), indexes.HnswIndex(spark, 64, ef_search=1)
    index.add_frame(e)
    index.set_ef_search(wide(e))
    return rounded(index.search_frame(first(spark, sf_dir), K), "distance")


SPARSE = "p as (select vec_id as id, label as dim, 1.0::double as w from embeddings union all select vec_id, 100 + vec_id % 7, 0.5 from embeddings)"


@query("sparse_index_search", f"with {SPARSE} select id, sum(w * case dim when 3 then 1.0 when 105 then 4.0 end)::double as score from p where dim in (3, 105) and id % 4 <> 2 group by id order by 2 desc, 1 limit {K}")
def sparse_index_search(spark, sf_dir):
    """Upserts that replace vectors, and deletes."""
    index, rows = indexes.SparseIndex(spark), vectors(spark, sf_dir).select("id", "label").collect()
    index.upsert_batch([(r.id, {3: 9.0, 200: 1.0}) for r in rows])
    index.upsert_batch([(r.id, {r.label: 1.0, 100 + r.id % 7: 0.5}) for r in rows if r.id % 4 != 2])
    index._change([(r.id, None) for r in rows if r.id % 4 == 2])
    return spark.createDataFrame([(f["id"], f["score"]) for f in index.search({3: 1.0, 105: 4.0}, K)], "id long, score double")


@query("knn_binary_cosine", ORACLE_SQL["knn_binary_l2"])
def knn_binary_cosine(spark, sf_dir):
    return rounded(search.knn_binary(vectors(spark, sf_dir), first(spark, sf_dir), K, "cosine"), "distance")


@query("knn_nan_last", KNN.format("id % 3 <> 0"))
def knn_nan_last(spark, sf_dir):
    """Vectors with a NaN are farther than all others."""
    nan = F.when(F.col("id") % 3 == 0, F.transform("vec", lambda x: x * F.lit(float("nan")).cast("float"))).otherwise(F.col("vec"))
    return rounded(search.knn(vectors(spark, sf_dir).withColumn("vec", nan), first(spark, sf_dir), K), "distance")


# Training.

MEANS = "select cid, list(x order by pos) as c from (select cid, pos, avg(x) as x from (select cid, unnest(v) as x, unnest(range(64))::integer as pos from {}) group by cid, pos) group by cid"


@query("kmeans_two_steps", f"""with {E}, {C}, {NEAREST}, c2 as ({MEANS.format('a')}),
    a2 as (select id, v, cid from (select *, row_number() over (partition by id order by {sq('v', 'c')}, cid) as n from e, c2) where n = 1), c3 as ({MEANS.format('a2')})
    select cid::integer as list_id, unnest(range(64))::integer as pos, round(unnest(c), 6) + 0.0::double as x from c3""")  # fmt: skip
def kmeans_two_steps(spark, sf_dir):
    """The loop, from fixed rows."""
    moved = cluster.kmeans(vectors(spark, sf_dir), SEEDS, passes=2, start=fixed(spark, sf_dir))
    return spark.createDataFrame([(i, j, float(x)) for i, row in enumerate(moved) for j, x in enumerate(row)], "list_id int, pos int, x double").withColumn("x", r6("x") + F.lit(0.0))


@query("pq_train_step", f"""with {E}, {C}, s as (select unnest(range({PARTS}))::integer as s),
    k as (select id, s, cid, list_slice(v, 8 * s + 1, 8 * s + 8) as w, {sq('list_slice(v, 8 * s + 1, 8 * s + 8)', 'list_slice(c, 8 * s + 1, 8 * s + 8)')} as d from e, c, s),
    b as (select id, s, cid, w from (select *, row_number() over (partition by id, s order by d, cid) as n from k) where n = 1),
    x as (select s, cid, unnest(w) as x, unnest(range(8))::integer as pos from b), m as (select s, cid, pos, avg(x) as x from x group by s, cid, pos),
    o as (select s, cid, unnest(list_slice(c, 8 * s + 1, 8 * s + 8)) as x0, unnest(range(8))::integer as pos from c, s)
    select o.s as part, o.cid::integer as code, o.pos, round(coalesce(m.x, o.x0), 6) + 0.0::double as x from o left join m using (s, cid, pos)""")  # fmt: skip
def pq_train_step(spark, sf_dir):
    """One pass of training a codebook, from fixed rows; a code that nothing is nearest to stays."""
    book = cluster.pq_train_from(vectors(spark, sf_dir), fixed(spark, sf_dir), PARTS, 1)
    rows = [(s, c, p, float(book[s, c, p])) for s, c, p in np.ndindex(book.shape)]
    return spark.createDataFrame(rows, "part int, code int, pos int, x double").withColumn("x", r6("x") + F.lit(0.0))


# Collections.


def filled(spark, sf_dir, kind: str, **options):
    """A collection of the index type: all rows, then a second batch that changes some and a third that deletes some."""
    c = Client(spark, folder(spark)).create_collection("items", 64, "l2", kind, **options)
    rows = vectors(spark, sf_dir).select("id", "vec", F.to_json(F.struct("label")).alias("payload"))
    moved = F.transform("vec", lambda x: x + F.lit(5.0).cast("float"))
    c.upsert_frame(rows.withColumn("vec", F.when(F.col("id") % 20 == 3, moved).otherwise(F.col("vec"))))
    return c, rows


def changed(c, rows):
    c.upsert_frame(rows.where("id % 20 = 3"))
    c.delete_frame(rows.where("id % 10 = 9").select("id"))
    return c


def _through(kind: str, options: dict) -> None:
    """Built before the last changes, which are searched beside the index."""

    @query(f"store_{kind}_search", f"with {E}, {Q} select id, round(list_distance(v, q), 6) as distance, label from (select * from e, q where id % 10 <> 9 order by list_distance(v, q), id limit {K})")
    def run(spark, sf_dir):
        c, rows = filled(spark, sf_dir, kind, **options)
        c.build()
        found = changed(c, rows).search_frame(first(spark, sf_dir), K)
        return found.select("id", r6("distance").alias("distance"), F.get_json_object("payload", "$.label").cast("int").alias("label"))

    @query(f"store_{kind}_filtered", f"with {E}, {Q} select id, round(list_distance(v, q), 6) as distance from (select * from e, q where id % 10 <> 9 and label in (1, 2) order by list_distance(v, q), id limit {K})")
    def filtered(spark, sf_dir):
        c, rows = filled(spark, sf_dir, kind, **options)
        found = changed(c, rows).search_frame(first(spark, sf_dir), K, {"label": {"$in": [1, 2]}})
        return found.select("id", r6("distance").alias("distance"))

    @query(f"store_{kind}_many", f"""with {E}, s as (select b.id as qid, a.id as id, list_distance(a.v, b.v) as d from e a, e b where b.id % 100 = 0 and a.id % 10 <> 9),
        r as (select *, row_number() over (partition by qid order by d, id) as n from s) select qid, id, round(d, 6) as distance, cast(n as integer) as "rank" from r where n <= {K}""")
    def many(spark, sf_dir):
        c, rows = filled(spark, sf_dir, kind, **options)
        c.build()
        return rounded(changed(c, rows).search_many(asked_hundredth(vectors(spark, sf_dir)), K), "distance")


for _kind, _options in (("ivf", {"ivf": {"n_lists": 8, "nprobe": 8}}), ("hnsw", {"hnsw": {"ef_search": 100_000}}), ("mmap_flat", {})):
    _through(_kind, _options)


@query("store_promoted_search", KNN.format("id % 10 <> 9"))
def store_promoted_search(spark, sf_dir):
    """A flat collection above its promotion threshold, searched by a graph."""
    c, rows = filled(spark, sf_dir, "flat", promotion_threshold=100, hnsw={"ef_search": 100_000})
    found = changed(c, rows).search_frame(first(spark, sf_dir), K)
    assert c._manifest()["promoted"]
    return rounded(found.select("id", "distance"), "distance")


@query("store_reopened", KNN.format("id % 10 <> 9"))
def store_reopened(spark, sf_dir):
    """Another client reads the index that the first one built, and ignores a batch that no manifest names."""
    c, rows = filled(spark, sf_dir, "ivf", ivf={"n_lists": 4, "nprobe": 4})
    c.build()
    changed(c, rows)
    c._read([c._manifest()["base"]]).write.parquet(f"{c.path}/log/{10**11:012d}-left-behind")
    again = Client(spark, c.path.rsplit("/", 1)[0]).get_collection("items")
    return rounded(again.search_frame(first(spark, sf_dir), K).select("id", "distance"), "distance")


@query("store_batch_dup", "select s_suppkey % 10 as id, round(s_acctbal, 2) as x from (select *, row_number() over (partition by s_suppkey % 10 order by s_suppkey desc) as n from supplier) where n = 1")
def store_batch_dup(spark, sf_dir):
    """One batch that has ids again and again: the last entry counts."""
    c = Client(spark, folder(spark)).create_collection("suppliers", 1, "l2", "flat")
    rows = table(spark, sf_dir, "supplier").orderBy("s_suppkey").collect()
    c.upsert_batch([(r.s_suppkey % 10, [0.0], {"x": r.s_acctbal}) for r in rows])
    return c.rows().select("id", F.round(F.get_json_object("payload", "$.x").cast("double"), 2).alias("x"))


HYBRID = f"""with {E}, {Q}, {SPARSE}, l as (select * from e where id % 6 <> 5), dd as (select id, list_distance(v, q) as distance from l, q order by 2, 1 limit {10 * K}),
    ss as (select id, sum(w * case dim when 3 then 1.0 when 105 then 4.0 end)::double as score from p where dim in (3, 105) and id % 6 <> 5 and id % 2 = 0 group by id order by 2 desc, 1 limit {10 * K}),
    dm as (select min(distance) as dmin, max(distance) as dmax from dd), sm as (select min(score) as smin, max(score) as smax from ss)
    select id, round(0.7::double * (1 - (coalesce(distance, dmax) - dmin) / greatest(dmax - dmin, 1e-9)) + 0.3::double * (coalesce(score, 0) - smin) / greatest(smax - smin, 1e-9), 6) as fused
    from dd full join ss using (id), dm, sm order by 2 desc, 1 limit {K}"""


def hybrid_of(spark, sf_dir):
    """Rows with sparse vectors (even ids), compacted; then vectors alone are replaced, so sparse ones stay, and some go."""
    c = Client(spark, folder(spark)).create_collection("hybrid", 64, "l2", "flat")
    sparse = F.map_from_arrays(F.array(F.col("label").cast("long"), 100 + F.col("id") % 7), F.array(F.lit(1.0), F.lit(0.5)))
    rows = vectors(spark, sf_dir).withColumn("sparse", F.when(F.col("id") % 2 == 0, sparse))
    c.upsert_frame(rows.select("id", F.transform("vec", lambda x: x * 2).alias("vec"), "sparse"))
    c.compact()
    c.upsert_frame(rows.select("id", "vec"))
    c.delete_frame(rows.where("id % 6 = 5").select("id"))
    return c


@query("store_hybrid_search", HYBRID)
def store_hybrid_search(spark, sf_dir):
    found = hybrid_of(spark, sf_dir).search_hybrid(first(spark, sf_dir), {3: 1.0, 105: 4.0}, K)
    return frame(spark, [f | {"fused": f["score"]} for f in found], "id long, fused double")


@query("store_sparse_counts", "select 'rows' as kind, count(*) as n from embeddings where vec_id % 6 <> 5 union all select 'sparse', count(*) from embeddings where vec_id % 2 = 0 and vec_id % 6 <> 5")
def store_sparse_counts(spark, sf_dir):
    c = hybrid_of(spark, sf_dir)
    return spark.createDataFrame([("rows", c.count), ("sparse", c.sparse_count)], "kind string, n long")


@query("store_snapshot_named", "select 'a' as name, count(*) as n, sum(vec_id)::bigint as total from embeddings union all select 'b', count(*), sum(vec_id)::bigint from embeddings where vec_id % 10 <> 9")
def store_snapshot_named(spark, sf_dir):
    """Two snapshots, compactions between them, and each restored by its name."""
    c, rows = filled(spark, sf_dir, "flat")
    c.create_snapshot("a")
    c.compact()
    changed(c, rows)
    c.create_snapshot("b")
    c.compact()
    c.delete_frame(rows.select("id"))
    out = []
    for name in ("a", "b"):
        c.restore_snapshot(name)
        out.append((name, *c.rows().agg(F.count("*"), F.sum("id")).first()))
    return spark.createDataFrame(out, "name string, n long, total long")


class Letters:
    """An embedding function: how often three letters occur, and the length."""

    dimensions = 4

    def __call__(self, texts):
        return [[float(t.count("a")), float(t.count("e")), float(t.count("o")), float(len(t))] for t in texts]


LETTERS = "[" + ", ".join(f"(length({{0}}) - length(replace({{0}}, '{x}', '')))::double" for x in "aeo") + ", length({0})::double]"


@query("embed_text_column", f"select doc_id as id, unnest({LETTERS.format('t')}) as x, unnest(range(4))::integer as pos from (select doc_id, coalesce(text, '') as t from documents)")
def embed_text_column(spark, sf_dir):
    made = embed_column(documents(spark, sf_dir), Letters())
    return made.select("id", F.posexplode("vec").alias("pos", "x")).select("id", "pos", F.col("x").cast("double").alias("x"))


@query("store_text_search", f"select p_partkey as id, round(list_distance({LETTERS.format('p_name')}, {LETTERS.format(chr(39) + 'a large green almond' + chr(39))}), 6) as distance from part order by 2, 1 limit {K}")
def store_text_search(spark, sf_dir):
    """Texts in, by the embedding function that is attached."""
    c = Client(spark, folder(spark)).create_collection("parts", 4, "l2", "flat")
    c.attach_embedder(Letters())
    c.upsert_frame(embed_column(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text")), Letters()).select("id", "vec"))
    return frame(spark, c.search_text("a large green almond", K))


TEXTS = TF.replace("from documents", "from documents where doc_id < 500 and doc_id % 10 <> 9 and text is not null")


@query("text_collection_keywords", f"""with {TEXTS}, {W}, {ASK}, ss as (select id, sum(w * q) as score from w join xq using (term) where w > 0 and q > 0 group by id order by 2 desc, 1 limit {10 * K}),
    sm as (select min(score) as smin, max(score) as smax from ss) select id, round((score - smin) / greatest(smax - smin, 1e-9), 6) as score from ss, sm order by 2 desc, 1 limit {K}""")  # fmt: skip
def text_collection_keywords(spark, sf_dir):
    """The first texts, added and deleted while the inverted lists follow, then asked by keywords."""
    t = TextCollection(Client(spark, folder(spark)), "texts", Letters())
    rows = documents(spark, sf_dir).where("id < 500 and text is not null").orderBy("id").collect()
    t.add([r.id for r in rows if r.id % 2], [r.text for r in rows if r.id % 2])
    t.query("words that nobody wrote", 1)  # stores the lists
    t.add([r.id for r in rows if not r.id % 2], [r.text for r in rows if not r.id % 2])
    t.delete([r.id for r in rows if r.id % 10 == 9])
    return frame(spark, t.query(asked(spark, sf_dir), K, mode="keyword"), "id long, score double")


@query("text_collection_documents", "select doc_id as id, length(text) as n from documents where doc_id < 200 and doc_id % 10 <> 9 and text is not null")
def text_collection_documents(spark, sf_dir):
    """Every document that a semantic query gives back, by its length."""
    t = TextCollection(Client(spark, folder(spark)), "texts", Letters(), metric="l2")
    rows = documents(spark, sf_dir).where("id < 200 and text is not null").collect()
    t.add([r.id for r in rows], [r.text for r in rows], [{"n": 1}] * len(rows))
    t.delete([r.id for r in rows if r.id % 10 == 9])
    found = t.query("anything", len(rows), mode="semantic")
    return spark.createDataFrame([(f["id"], len(f["document"])) for f in found], "id long, n long")


def spaces_of(spark, sf_dir):
    m = MultiVectorCollection(Client(spark, folder(spark)), "pairs", {"first": {"dimensions": 32, "metric": "cosine"}, "second": {"dimensions": 32, "metric": "l2"}})
    rows = vectors(spark, sf_dir).collect()
    m.upsert_batch([(r.id, {"first": r.vec[:32], "second": r.vec[32:]}, {"label": r.label}) for r in rows])
    return m


@query("spaces_search_one", f"with {E}, {Q} select id, round(list_distance(list_slice(v, 33, 64), list_slice(q, 33, 64)), 6) as distance from e, q where label <= 2 order by 2, 1 limit {K}")
def spaces_search_one(spark, sf_dir):
    return frame(spark, spaces_of(spark, sf_dir).search("second", first(spark, sf_dir)[32:], K, {"label": {"$lte": 2}}))


@query("spaces_search_multi", spaces_sql(0.75, 0.25))
def spaces_search_multi(spark, sf_dir):
    q = first(spark, sf_dir)
    found = spaces_of(spark, sf_dir).search_multi({"first": q[:32], "second": q[32:]}, K, {"first": 3.0, "second": 1.0})
    rows = [(f["id"], f["score"], f["distances"].get("first"), f["distances"].get("second")) for f in found]
    return rounded(spark.createDataFrame(rows, "id long, score double, d_first double, d_second double"), "score", "d_first", "d_second")


@query("server_search", KNN.format("label >= 3"))
def server_search(spark, sf_dir):
    """Created, filled and asked by requests."""
    client = Client(spark, folder(spark))
    respond(client, "POST", "/collections", {"name": "c", "dimensions": 64, "metric": "l2", "index_type": "flat"})
    rows = vectors(spark, sf_dir).collect()
    respond(client, "POST", "/collections/c/upsert_batch", {"entries": [{"id": r.id, "vector": list(r.vec), "payload": {"label": r.label}} for r in rows]})
    status, found = respond(client, "POST", "/collections/c/search", {"query": first(spark, sf_dir), "k": K, "filter": {"label": {"$gte": 3}}})
    assert status == 200
    return frame(spark, found["results"])


@query("store_payload_omitted", "select vec_id as id, vec_id % 2 = 0 as has_payload from embeddings where vec_id < 20")
def store_payload_omitted(spark, sf_dir):
    c = Client(spark, folder(spark)).create_collection("c", 64, "l2", "flat")
    rows = vectors(spark, sf_dir).where("id < 20").collect()
    c.upsert_batch([(r.id, r.vec, {"label": r.label}) if r.id % 2 == 0 else (r.id, r.vec) for r in rows])
    return spark.createDataFrame([(f["id"], "payload" in f) for f in c.search(first(spark, sf_dir), 100)], "id long, has_payload boolean")
