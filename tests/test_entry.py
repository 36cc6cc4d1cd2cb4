"""The registered queries against DuckDB over the smallest tables, and the guard around the corpus operators."""

import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables aren't here")
SOME = [
    "knn_cosine", "knn_batch_l2", "knn_filtered_overscan", "filter_and", "filter_json_kinds", "filter_struct_dotted", "knn_int8", "knn_fp16", "knn_binary_dot", "ivf_knn_nprobe4", "pq_adc_knn", "ivfpq_knn", "kmeans_one_step",
    "bm25_weights", "bm25_as_of_insert", "hybrid_fusion", "multi_space_partial", "delete_tombstones", "snapshot_diff", "store_search", "stream_upsert", "op6_extendible_shards", "op8_winnowing",
    "bm25_topk", "bm25_topk_unindexed", "sparse_topk", "keyword_index_changes", "hnsw_exact_cosine", "hnsw_exact_without_deleted", "index_flat_knn", "index_save_load", "kmeans_two_steps", "pq_train_step", "knn_nan_last",
    "store_ivf_search", "store_hnsw_many", "store_promoted_search", "store_reopened", "store_hybrid_search", "store_snapshot_named", "text_collection_keywords", "spaces_search_multi", "server_search", "sparse_index_search",
]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def rows(df):
    df = df[sorted(df.columns)]
    plain = df.astype(object).where(df.notna(), None)
    return sorted(repr(tuple(round(x, 9) if isinstance(x, float) else x for x in r)) for r in plain.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", [n for n in SOME if n in entry.oracle_sql()])
def test_queries_equal_sql(spark, duck, name):
    got, want = entry.queries()[name](spark, SF).toPandas(), duck.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


HUNDREDTH = ["knn_hundredth_l2", "knn_hundredth_cosine", "knn_hundredth_dot", "knn_hundredth_columns_l2", "recall_int8_hundredth", "ivf_knn_hundredth", "pairwise_stats_all"]


@pytest.mark.parametrize("name", HUNDREDTH)
def test_whole_query_sets_equal_sql(spark, duck, name):
    got, want = entry.queries()[name](spark, SF).toPandas(), duck.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)
    step = 1 if name == "pairwise_stats_all" else 100
    ids = {i for (i,) in duck.execute(f"select vec_id from embeddings where vec_id % {step} = 0").fetchall()}
    assert set(got.qid) == ids and max(ids) >= 20


def test_all_sparse_pairs_equal_sql(spark, duck):
    got, want = entry.queries()["sparse_dot_pairs_all"](spark, SF).toPandas(), duck.execute(entry.oracle_sql()["sparse_dot_pairs_all"]).df()
    assert rows(got) == rows(want) and len(got) == duck.execute("select count(*) from documents").fetchone()[0]


def test_filtered_fusion_equals_sql(spark, duck):
    for name in ("hybrid_fusion_filtered", "hybrid_fusion_filtered_exact"):
        assert rows(entry.queries()[name](spark, SF).toPandas()) == rows(duck.execute(entry.oracle_sql()[name]).df())


def test_graph_recall_over_the_whole_query_set(spark):
    got = entry.queries()["hnsw_recall_hundredth"](spark, SF).toPandas()
    assert sorted(got.qid) == list(range(0, 500, 100)) and got.recall.mean() >= 0.9


def test_flagship(spark):
    assert entry.entry(spark).count() == 10


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_without_what_the_corpus_operators_need():
    """Where a library of theirs is missing, the other queries are there."""
    home = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "import sys; sys.modules['xxhash'] = None; import __spark_entry__ as e; q = e.queries(); assert 'knn_cosine' in q and not any(n.startswith('op') or n == 'pipeline' for n in q)"
    run = subprocess.run([sys.executable, "-c", code], cwd=home, capture_output=True, text=True)
    assert run.returncode == 0, run.stderr


def test_without_the_corpus_operators(tmp_path):
    """A copy of the repository without them imports and keeps its other queries."""
    home = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for name in ("vecframe", "__spark_entry__.py"):
        os.symlink(os.path.join(home, name), tmp_path / name) if name.endswith(".py") else None
    for base, folders, files in os.walk(os.path.join(home, "vecframe")):
        folders[:] = [f for f in folders if f not in ("llm", "__pycache__")]
        to = tmp_path / os.path.relpath(base, home)
        to.mkdir(exist_ok=True)
        for f in files:
            os.symlink(os.path.join(base, f), to / f)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'knn_cosine' in q and not any(n.startswith('op') or n == 'pipeline' for n in q); print(len(e.oracle_sql()))"
    # The entry file is read through a link, so the copy's own folder goes first.
    run = subprocess.run([sys.executable, "-c", f"import sys; sys.path.insert(0, {str(tmp_path)!r}); {code}"], cwd=tmp_path, capture_output=True, text=True)
    assert run.returncode == 0, run.stderr
