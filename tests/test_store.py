import json
import threading
import urllib.error
import urllib.request

import pytest

from vecframe import errors
from vecframe.operators import keyword, search
from vecframe.sources.collections import MultiVectorCollection, TextCollection
from vecframe.sources.embed import EmbeddingFunction, OpenAIEmbedding, embed_column
from vecframe.sources.postings import KeywordIndex
from vecframe.sources.server import create_server, respond
from vecframe.sources.store import INDEX_TYPES, Client
from vecframe.streaming.ingest import alerts, upsert_stream


class Letters:
    """Counts of a few letters."""

    dimensions = 4

    def __call__(self, texts):
        return [[1.0 + t.count("a"), 1.0 + t.count("e"), 1.0 + t.count("o"), float(len(t))] for t in texts]


@pytest.fixture
def client(spark, tmp_path):
    return Client(spark, str(tmp_path / "data"))


AXES = [[1, 0, 0, 0], [0, 1, 0, 0], [0, 0, 1, 0], [0, 0, 0, 1]]


def test_catalogue(client):
    client.create_collection("b", 4)
    client.create_collection("a", 4, "l2", "flat")
    assert client.list_collections() == ["a", "b"]
    with pytest.raises(KeyError):
        client.create_collection("a", 4)
    with pytest.raises(KeyError):
        client.get_collection("none")
    assert client.get_or_create_collection("a", 9).dimensions == 4
    assert client.delete_collection("a") and not client.delete_collection("a")
    for bad in ("", "a/b", "..", "a\\b"):
        with pytest.raises(ValueError):
            client.create_collection(bad, 4)
    for options in ({"metric": "x"}, {"index_type": "x"}):
        with pytest.raises(ValueError):
            client.create_collection("c", 4, **options)


def test_upserts_deletes_and_reopening(spark, client):
    c = client.create_collection("c", 4, "l2", "flat")
    c.upsert(1, AXES[0], {"cat": "x"})
    c.upsert_batch([(2, AXES[1]), (2, AXES[2], {"cat": "last"}), (3, AXES[3])])
    c.upsert(1, AXES[1])
    assert c.count == 3
    again = Client(spark, client.path).get_collection("c")
    found = again.search(AXES[1], 3)
    assert found[0] == {"id": 1, "distance": 0.0} and found[1]["id"] in (2, 3)
    assert {"cat": "last"} in [f.get("payload") for f in found]
    assert c.delete(2) and not c.delete(2) and c.count == 2
    with pytest.raises(ValueError):
        c.upsert(1, [1.0])
    with pytest.raises(ValueError):
        c.search([1.0], 1)
    with pytest.raises(ValueError):
        c.upsert(-1, AXES[0])


@pytest.mark.parametrize("kind", INDEX_TYPES)
def test_every_index_type(client, kind):
    c = client.create_collection("c", 4, "l2", kind, ivf={"n_lists": 2, "nprobe": 2, "pq_m": 2, "pq_k_sub": 4})
    assert c.search([0.0, 1.0, 0.1, 0.0], 2) == []
    c.upsert_batch([(i, [v + 0.01 * i for v in AXES[i]], {"n": i}) for i in range(4)])
    found = c.search([0.0, 1.0, 0.1, 0.0], 2)
    assert len(found) == 2 and (kind == "binary_flat" or found[0]["id"] == 1) and found[0]["payload"]["n"] == found[0]["id"]
    assert {f["id"] for f in c.search([0.0, 1.0, 0.1, 0.0], 4, {"n": {"$gte": 2}})} == {2, 3}
    assert {f["id"] for f in c.search([0.0, 1.0, 0.1, 0.0], 4, {"n": {"$gte": 2}}, mode="overscan")} == {2, 3}
    c.upsert(9, [0.0, 1.0, 0.1, 0.0])
    assert kind in ("binary_flat", "ivf_pq") or c.search([0.0, 1.0, 0.1, 0.0], 1)[0]["id"] == 9


def test_hybrid(client):
    c = client.create_collection("c", 4, "l2", "flat")
    c.upsert_hybrid(1, AXES[0], {0: 0.9, 10: 0.5}, {"cat": "tech"})
    c.upsert_hybrid(2, AXES[1], {10: 0.8, 20: 0.6}, {"cat": "science"})
    c.upsert_hybrid(3, AXES[2], {0: 0.7, 20: 0.3}, {"cat": "tech"})
    assert c.sparse_count == 3
    assert c.search_hybrid(AXES[1], {10: 1.0}, 1)[0]["id"] == 2
    assert c.search_hybrid(AXES[1], {0: 1.0}, 1, 0.0, 1.0)[0]["id"] == 1
    assert {r["id"] for r in c.search_hybrid(AXES[1], {10: 1.0}, 3, filter={"cat": {"$eq": "tech"}})} == {1, 3}
    c.upsert(1, AXES[3])
    assert c.sparse_count == 3 and c.search_sparse({0: 1.0}, 1)[0]["id"] == 1
    c.delete(1)
    c.upsert(1, AXES[0])
    assert c.sparse_count == 2


def test_snapshots_and_compaction(client):
    c = client.create_collection("c", 4, "l2", "flat")
    c.upsert_batch([(i, AXES[i % 4], {"i": i}) for i in range(5)])
    info = c.create_snapshot("one")
    assert info["vector_count"] == 5 and [s["name"] for s in c.list_snapshots()] == ["one"]
    c.upsert_batch([(100 + i, AXES[i % 4]) for i in range(5)])
    c.delete(0)
    assert c.compact() and c.count == 9 and len(c.files.names(f"{c.path}/log")) == 2
    assert c.rows("one").count() == 5
    c.restore_snapshot("one")
    assert c.count == 5 and c.search(AXES[0], 1)[0]["payload"] == {"i": 0}
    with pytest.raises(KeyError):
        c.create_snapshot("one")
    for f in (c.restore_snapshot, c.delete_snapshot):
        with pytest.raises(KeyError):
            f("two")
        with pytest.raises(ValueError):
            f("../one")
    c.delete_snapshot("one")
    assert c.list_snapshots() == [] and c.count == 5


def test_compaction_by_itself(client):
    c = client.create_collection("c", 4, "l2", "flat", compaction_threshold=6)
    for _ in range(4):
        c.upsert_batch([(i, AXES[i]) for i in range(4)])
    assert c.count == 4 and c.changes().count() < 16


def test_unnamed_batches_are_ignored(client):
    c = client.create_collection("c", 4, "l2", "flat")
    c.upsert(1, AXES[0])
    folder = c._manifest()["log"][0]
    c.spark.read.parquet(f"{c.path}/{folder}").write.parquet(f"{c.path}/log/000000000099-broken")
    assert c.changes().count() == 1


def test_manifests_that_are_broken_are_passed_over(client):
    c = client.create_collection("c", 4, "l2", "flat")
    c.upsert(1, AXES[0])
    c.files.write(f"{c.path}/manifest/{99:012d}.json", '{"log": [')
    assert c.count == 1
    c.upsert(2, AXES[1])
    assert c.count == 2 and len(c.files.versions(f"{c.path}/manifest")) == 3
    with pytest.raises(OSError):
        c.files.write(f"{c.path}/meta.json", "{}")
    client.create_collection("d", 4)
    for n in c.files.names(f"{client.path}/d/manifest"):
        c.files.delete(f"{client.path}/d/manifest/{n}")
    with pytest.warns(UserWarning, match="d"):
        assert client.list_collections() == ["c"]


def test_changes_beside_an_index(client):
    """An upsert after building neither rebuilds the index nor is missed; many changes make a new base."""
    c = client.create_collection("c", 4, "l2", "ivf", ivf={"n_lists": 2, "nprobe": 2})
    c.upsert_batch([(i, [float(i), 0, 0, 0], {"n": i}) for i in range(40)])
    assert c.search([7.0, 0, 0, 0], 1)[0]["id"] == 7
    base = c._manifest()["base"]
    c.upsert(7, [500.0, 0, 0, 0])
    c.upsert(100, [7.1, 0, 0, 0], {"n": 100})
    assert [f["id"] for f in c.search([7.0, 0, 0, 0], 2)] == [100, 6] and c._manifest()["base"] == base
    assert c.delete_batch([100, 6, 12345]) == 2 and c.search([7.0, 0, 0, 0], 1)[0]["id"] == 8
    assert [r.id for r in c.search_many(c.spark.createDataFrame([(1, [7.0, 0.0, 0.0, 0.0])], "qid long, qvec array<double>"), 2).orderBy("rank").collect()] == [8, 5]
    c.upsert_batch([(1000 + i, [float(i), 1, 0, 0]) for i in range(1001)])
    assert c.search([7.0, 1, 0, 0], 1)[0]["id"] == 1007 and c._manifest()["base"] != base and c.count == 39 + 1001
    assert c.files.names(f"{c.path}/index") == [c._manifest()["base"].rsplit("/", 1)[1]]


def test_promotion(client):
    c = client.create_collection("c", 4, "l2", "flat", promotion_threshold=3)
    c.upsert_batch([(i, AXES[i]) for i in range(4)])
    assert c.search(AXES[2], 1)[0]["id"] == 2 and c.files.exists(f"{c.path}/index")


def test_text_collection(client):
    t = TextCollection(client, "t", Letters())
    t.add([1, 2, 3], ["apple banana fruit", "orange engine motor", "banana bread recipe"], [{"cat": "a"}, None, {"cat": "b"}])
    assert t.count == 3 and isinstance(t.embedding, EmbeddingFunction)
    top = t.query("motor", 1, mode="keyword")[0]
    assert top["id"] == 2 and top["document"] == "orange engine motor" and "_document" not in top.get("payload", {})
    assert t.query("zzz", 3, mode="keyword") == [] and "distance" in t.query("zzz", 1)[0]
    assert {r["id"] for r in t.query("banana", 3, filter={"cat": {"$eq": "b"}})} == {3}
    assert len(t.query("banana", 2, mode="semantic")) == 2
    for bad in (lambda: t.query("a", mode="other"), lambda: t.add([1], []), lambda: TextCollection(client, "t", Letters(), bm25=False).query("a", mode="keyword")):
        with pytest.raises(ValueError):
            bad()
    t.delete([2])
    assert t.count == 2 and all(r["id"] != 2 for r in t.query("motor", 3))


def test_wide_beam_of_a_collection_is_exact_among_copies(client, spark):
    rows = spark.range(2000).selectExpr("id", "transform(sequence(1, 8), i -> if(id < 1500, 0.5D, (xxhash64(id, i) % 1000) / 1000D)) as vec")
    c = client.create_collection("c", 8, "l2", "hnsw", hnsw={"m": 4, "ef_search": 100_000})
    c.upsert_frame(rows)
    asked = rows.where("id % 100 = 0").selectExpr("id as qid", "vec as qvec")
    found = lambda df: sorted((r.qid, r["rank"], r.id) for r in df.collect())
    assert found(c.search_many(asked, 10)) == found(search.knn_batch(rows, asked, 10))


def test_keyword_index(spark, tmp_path):
    docs = lambda rows: spark.createDataFrame(rows, "id long, text string")
    path = str(tmp_path / "words")
    index = KeywordIndex.build(docs([]), path)
    assert index.count == 0 and index.top("apple", 3).collect() == [] and index.weights("apple") == {}
    index.add(docs([(1, "apple apple pie"), (2, "orange pie"), (3, None), (4, "the of")]))
    index.remove(docs([(99, "")]))
    index.upsert(docs([(2, "cherry apple"), (5, "cherry")]))
    want = docs([(1, "apple apple pie"), (2, "cherry apple"), (5, "cherry")])
    for q in ("apple", "cherry pie", "orange", "nothing at all", ""):
        again = KeywordIndex(spark, path)
        found = [(r.id, round(r.score, 9)) for r in again.top(q, 5).collect()]
        assert found == [(r.id, round(r.score, 9)) for r in keyword.bm25_top(want, q, 5).collect()]
    assert again.count == 3 and again.average_length == 2.0 and again.frequencies(["apple", "orange"]) == {"apple": 2}


def test_several_spaces(client):
    m = MultiVectorCollection(client, "m", {"text": 4, "image": {"dimensions": 4, "metric": "l2"}}, "l2")
    m.upsert(1, {"text": [1, 0, 0, 0], "image": [0, 0, 0, 1]}, {"cat": "a"})
    m.upsert_batch([(2, {"text": [0, 0, 0, 1], "image": [1, 0, 0, 0]}), (3, {"text": [0.9, 0.1, 0, 0], "image": [0.9, 0.1, 0, 0]}, {"cat": "b"}), (4, {"image": [0, 5, 0, 0]}, {"cat": "a"})])
    found = m.search_multi({"text": [1, 0, 0, 0], "image": [1, 0, 0, 0]}, 3)
    assert found[0]["id"] == 3 and found[0]["payload"] == {"cat": "b"} and set(found[0]["distances"]) == {"text", "image"}
    assert m.search("text", [1, 0, 0, 0], 1)[0]["id"] == 1 and m.search("image", [0, 5, 0, 0], 1, {"cat": {"$eq": "a"}})[0]["id"] == 4
    assert {r["id"] for r in m.search_multi({"image": [1, 0, 0, 0]}, 5, filter={"cat": {"$eq": "a"}})} == {1, 4}
    assert m.count == 4 and m.vector_spaces == ["image", "text"]
    m.delete_batch([3, 4])
    assert m.count == 2
    with pytest.raises(KeyError):
        m.upsert(1, {"sound": [1]})
    with pytest.raises(ValueError):
        MultiVectorCollection(client, "n", {})


def test_embedding_column(spark):
    df = spark.createDataFrame([(1, "aa"), (2, None)], "id long, text string")
    assert {r.id: r.vec[0] for r in embed_column(df, Letters()).collect()} == {1: 3.0, 2: 1.0}
    assert OpenAIEmbedding().dimensions == 1536 and OpenAIEmbedding("another", dimensions=7).dimensions == 7 and OpenAIEmbedding("another").dimensions is None


def test_requests(client):
    ask = lambda method, path, body=None: respond(client, method, path, body or {})
    assert ask("GET", "/healthz") == (200, {"status": "ok"})
    assert ask("POST", "/collections", {"name": "c", "dimensions": 4, "metric": "l2", "index_type": "flat"})[0] == 201
    assert ask("POST", "/collections", {"name": "c", "dimensions": 4})[0] == 409 and ask("POST", "/collections", {"name": "x"})[0] == 400
    assert ask("POST", "/collections/c/upsert", {"id": 1, "vector": AXES[0], "payload": {"a": 1}})[1] == {"upserted": 1}
    assert ask("POST", "/collections/c/upsert_batch", {"entries": [{"id": 2, "vector": AXES[1]}]})[1] == {"upserted": 1}
    assert ask("POST", "/collections/c/search", {"query": AXES[0], "k": 1, "filter": {"a": {"$eq": 1}}})[1]["results"] == [{"id": 1, "distance": 0.0, "payload": {"a": 1}}]
    assert ask("POST", "/collections/c/search", {"query": [1]})[0] == 400 and ask("POST", "/collections/c/search", {"query": AXES[0], "filter": {"a": 1}})[0] == 400
    assert ask("GET", "/collections/c/count")[1] == {"count": 2} and ask("GET", "/collections/none/count")[0] == 404 and ask("GET", "/nothing")[0] == 404
    assert ask("POST", "/collections/c/snapshots", {"name": "s"})[0] == 201 and len(ask("GET", "/collections/c/snapshots")[1]["snapshots"]) == 1
    assert ask("POST", "/collections/c/delete", {"id": 2})[1] == {"deleted": True}
    assert ask("POST", "/collections/c/snapshots/restore", {"name": "s"})[0] == 200 and ask("GET", "/collections/c/count")[1] == {"count": 2}
    assert ask("DELETE", "/collections/c/snapshots/s")[0] == 200 and ask("DELETE", "/collections/c/snapshots/s")[0] == 404
    assert ask("GET", "/collections")[1] == {"collections": ["c"]} and ask("DELETE", "/collections/c")[0] == 200 and ask("DELETE", "/collections/c")[0] == 404


def test_server(spark, tmp_path):
    server = create_server(spark, str(tmp_path / "d"), port=0)
    thread = threading.Thread(target=server.serve_forever, daemon=True)
    thread.start()
    url = f"http://127.0.0.1:{server.server_port}"
    try:
        with urllib.request.urlopen(f"{url}/healthz", timeout=20) as answer:
            assert json.load(answer) == {"status": "ok"} and answer.headers["Access-Control-Allow-Origin"] == "*"
        with pytest.raises(urllib.error.HTTPError) as e:
            urllib.request.urlopen(urllib.request.Request(f"{url}/collections", b"not json", method="POST"), timeout=20)
        assert e.value.code == 400
    finally:
        server.shutdown()


def test_streams(spark, client, tmp_path):
    c = client.create_collection("c", 2, "l2", "flat")
    folder = str(tmp_path / "in")
    spark.createDataFrame([(1, [1.0, 0.0], 0), (1, [0.0, 1.0], 1), (2, [1.0, 1.0], 0)], "id long, vec array<float>, n long").write.parquet(folder)
    stream = spark.readStream.schema("id long, vec array<float>, n long").parquet(folder)
    for _ in range(2):
        upsert_stream(stream, c, str(tmp_path / "state")).awaitTermination()
    assert c.count == 2 and c.search([0.0, 1.0], 1)[0] == {"id": 1, "distance": 0.0} and c.changes().count() == 3
    q = alerts(stream, [1.0, 0.0], 0.5).writeStream.format("memory").queryName("near").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r.id for r in spark.table("near").collect()] == [1]


def test_repeated_batch_is_recognised(spark, client):
    c = client.create_collection("c", 2, "l2", "flat")
    df = spark.createDataFrame([(1, [1.0, 0.0])], "id long, vec array<float>")
    assert c.upsert_frame(df, "b:1") and not c.upsert_frame(df, "b:1") and c.changes().count() == 1
    assert isinstance(errors.DuplicateId(1), KeyError)


def test_embedder_of_a_collection(client):
    c = client.create_collection("c", 4, "l2", "flat")
    with pytest.raises(RuntimeError):
        c.search_text("a", 1)
    c.attach_embedder(Letters())
    c.upsert_text(1, "banana", {"t": 1})
    c.upsert_text(2, "ooo")
    assert c.search_text("banana", 1) == [{"id": 1, "distance": 0.0, "payload": {"t": 1}}]
    with pytest.raises(ValueError):
        client.create_collection("d", 3).attach_embedder(Letters())


def test_few_collections_stay_loaded(client):
    client.loaded = 2
    for name in "abc":
        client.create_collection(name, 2)
    assert list(client.open) == ["b", "c"] and client.get_collection("a").name == "a" and list(client.open) == ["c", "a"]
