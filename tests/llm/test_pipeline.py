import hashlib
import random

import numpy as np
import pytest

import corpus_pipeline
from tests.llm.test_operators import PASSAGE, WORD, brute_components, brute_toxicity, brute_winnow, labelled, prose
from vecframe.llm import log_templates, simhash_vp, toxicity
from vecframe.llm.wordcache import load


CLASHING = ["ka", "kb", "a.b", "__n_lines", "kept_0", "fp", "w", "item", "gone", "c0"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("corpus")
    train, labels = labelled(spark)
    r = random.Random(8)
    text = prose(90, r)
    extra = [
        (1000, text), (1001, text), (1002, text.replace(text.split()[40], "zzz", 1)), (1003, None), (1004, ""), (1005, prose(10, r) + " " + PASSAGE), (1006, prose(50, r)), (1006, prose(60, r)), (None, prose(50, r)),
        *((2000 + i, "Shared boiler plate line here\n" + prose(40, r)) for i in range(5)), (3000, prose(30, r) + ". you utter scum of it. " + prose(20, r)),
    ]
    docs = train.unionByName(spark.createDataFrame(extra, "doc_id long, text string")).selectExpr("doc_id", "text", "'en' as lang", "'s' as source", "cast(length(text) as long) as n_chars", *[f"{i} as `{c}`" for i, c in enumerate(CLASHING)])
    docs.write.parquet(f"{base}/documents.parquet")
    labels.write.parquet(f"{base}/labels.parquet")
    spark.createDataFrame([(1, PASSAGE), (2, prose(20, r))], "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
    return str(base)


def test_stages_one_by_one(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, names = docs.columns, [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, folder).persist()
        assert after.columns == columns and [f.dataType for f in after.schema] == [f.dataType for f in docs.schema]
        rows, kept = ([(r.doc_id, r.text) for r in x.collect()] for x in (before, after))
        ids = {i for i, _ in kept}
        if name == "toxicity":
            assert 3000 not in ids and {1000, 1003, 1004, 1006, None} <= ids
        elif name == "line dedup":
            assert sorted(map(repr, kept)) == sorted(map(repr, zip([i for i, _ in rows], log_templates.brute_force(rows), strict=True)))
        elif name == "SimHash near-dedup":
            classes = {w[2] for w in brute_components(rows)}  # the two rows of doc_id 1006 are classes of their own
            assert ids == classes and len(kept) == len(classes) + 1 and 1004 not in ids  # 1001 is empty by now and stands for 1003 and 1004
        else:
            bad = {w[0] for w in brute_winnow(rows, [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]) if w[-1]}
            assert ids == {i for i, _ in rows} - bad and 1005 in bad
        before = after
    assert corpus_pipeline.STAGES[-1][1](spark, before, folder).count() == before.count()


def brute_pipeline(spark, folder):
    """The rows of the last stage, by the brute-force version of every stage; only toxicity's weights are Spark's."""
    read = lambda name: spark.read.parquet(f"{folder}/{name}.parquet")
    model = toxicity.fit(read("documents"), read("labels"))
    rows = [(r.doc_id, r.text) for r in read("documents").collect() if brute_toxicity(model, r.text) < 0.5]
    rows = list(zip([d for d, _ in rows], log_templates.brute_force(rows), strict=True))
    fp = [simhash_vp.fingerprint((t or "").encode()) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (fp[i] ^ fp[j]).bit_count() <= 4:
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    best = {}
    for g, r in zip(group, rows, strict=True):
        best[g] = min(best.get(g, r), r, key=lambda x: (x[0] is None, x[0] or 0))
    rows = list(best.values())
    bad = brute_winnow(rows, [(r.item_id, r.text) for r in read("benchmark").collect()])
    lib, out = load(WORD), []
    for (d, t), found in zip(rows, bad, strict=True):
        if not found[-1]:
            ids = lib.encode(t or "", add_special_tokens=False).ids
            out.append((d, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(lib.decode(ids, skip_special_tokens=False).encode())))
    return out


def sha(data):
    return hashlib.sha256(data).hexdigest()


def test_run_equals_brute_force(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_reused"]
    rows = out.collect()
    assert sorted((r[:4] for r in rows), key=repr) == sorted(brute_pipeline(spark, folder), key=repr)
    ids = {r.doc_id for r in rows}
    assert 1005 not in ids and 3000 not in ids and 1000 in ids


def test_empty_tables(spark, folder, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
