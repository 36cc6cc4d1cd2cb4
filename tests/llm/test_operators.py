"""Every operator against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables and extra columns."""

import hashlib
import math
import os
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import zstandard
from pyspark.sql import functions as F

from vecframe.llm import avi, chunk_bpe, compress_quality, extendible, log_templates, simhash_vp, substring_dedup, token_store, toxicity, winnow
from vecframe.llm.wordcache import load

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
R = random.Random(5)
WORDS = ["".join(R.choice("etaoinshrdlu") for _ in range(R.randint(2, 8))) for _ in range(400)]


def prose(n, r=R):
    return " ".join(r.choice(WORDS) for _ in range(n))


PASSAGE = prose(70)
ROWS = [
    (1, "x" + prose(120)), (2, None), (3, ""), (4, "   \n "), (5, PASSAGE), (6, prose(20) + " " + PASSAGE + " " + prose(30)), (7, PASSAGE), (7, PASSAGE), (7, "other text of the same id"), (None, "a text without id " + PASSAGE),
    (None, None), (8, "é É İ ﬁ 日本 <|endoftext|> <|startoftext|>  two  spaces"), (9, "ab" * 4000), (10, prose(4000)), (11, "tiny"), (12, "line one\nline two\n" + prose(12)), (13, "line one\nline two 17\n" + prose(12)), (14, "line one\nline two 18\n" + prose(9)),
    (15, PASSAGE.replace("e", "E", 1)), (16, "a a a a a a a a"), (17, prose(300) + "!"),
]


@pytest.fixture(scope="module")
def docs(spark):
    """With columns whose names the operators use themselves."""
    df = spark.createDataFrame([(i, t, f"s{n % 3}", n) for n, (i, t) in enumerate(ROWS)], "doc_id long, text string, source string, n long")
    own = "fp component shard label id line ka kb r gone a.b __n_lines __n_dropped kept_0 c1 __text t k n_bytes wanted hits home `q`".split()
    return df.select("doc_id", "text", "source", "n", *[F.lit(i).alias(c) for i, c in enumerate(own)]).persist()


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def key(r):
    return (r[0] is None, r[0] or 0, *map(str, r[1:]))


def same(got, want):
    assert sorted(map(tuple, got), key=key) == sorted(map(tuple, want), key=key)


def test_token_shards(spark, docs, none, tmp_path):
    for i, size in enumerate((1 << 22, 2000)):
        path = str(tmp_path / f"t{i}")
        token_store.write_token_shards(docs, path, BYTE, shard_bytes=size)
        got = token_store.read_token_shards(spark, path).collect()
        lib, want, start = load(BYTE), [], 0
        texts = spark.createDataFrame([(t,) for _, t in ROWS], "t string").select("t", token_store.order_of_text("t").alias("h"))
        order = {r.t: (r.h is not None, r.h) for r in texts.collect()}
        for d, t in sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, *order[r[1]])):
            ids = [*lib.encode(t or "", add_special_tokens=False).ids, 2]
            want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            start += len(ids)
        same([(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got], want)
        assert all(r.by_index == (r.doc_id is not None) for r in got)
        assert token_store.lookup(spark, path, 11) == [[*lib.encode("tiny", add_special_tokens=False).ids, 2]]
        assert sorted(token_store.lookup(spark, path, 7)) == sorted([*lib.encode(t, add_special_tokens=False).ids, 2] for d, t in ROWS if d == 7)
        assert token_store.lookup(spark, path, 999) == [] and len(token_store.lookup(spark, path, 10)[0]) > 4000
    hot = spark.createDataFrame([(1, "a copy")] * 60 + [(1, f"text {i}") for i in range(60)] + [(None, "x")] * 60, "doc_id long, text string").repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # or so few rows are one task's
    token_store.write_token_shards(hot, str(tmp_path / "h"), BYTE)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = token_store.read_token_shards(spark, str(tmp_path / "h"))
    assert got.count() == 180 and got.select("shard").distinct().count() > 2 and len(token_store.lookup(spark, str(tmp_path / "h"), 1)) == 120
    starts = sorted((r.start, r.n_tokens) for r in got.collect())
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:]))
    token_store.write_token_shards(none, str(tmp_path / "n"), BYTE)
    assert token_store.read_token_shards(spark, str(tmp_path / "n")).count() == 0


def test_substring_dedup(docs, none):
    want = [(d, len((t or "").encode()), *x[:2], x[2]) for (d, t), x in zip(ROWS, substring_dedup.brute_force([(t or "").encode() for _, t in ROWS]), strict=True)]
    got = substring_dedup.remove_repeats(docs).collect()
    same([(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got], want)
    assert all(r.kept_sha256 == hashlib.sha256(bytes(r.kept)).hexdigest() for r in got)
    assert substring_dedup.remove_repeats(none).count() == 0


def test_substring_dedup_of_split_minimisers(spark):
    """Groups over 400 bytes are split by classes, up to the finest."""
    r = random.Random(11)
    rows = [(i, prose(r.randrange(30), r) + " " + PASSAGE[r.randrange(60) : 200 + r.randrange(200)] + " " + prose(r.randrange(30), r)) for i in range(60)]
    rows += [(100, PASSAGE), (100, PASSAGE), (101, "ab" * 500), (102, None), (None, PASSAGE[7:260])]
    want = [(d, *x) for (d, _), x in zip(rows, substring_dedup.brute_force([(t or "").encode() for _, t in rows]), strict=True)]
    for split in (1 << 22, 3000, 400):
        got = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), split=split).collect()
        same([(r.doc_id, r.n_removed, r.n_spans, bytes(r.kept)) for r in got], want)


def brute_shots(text):
    """Shots of a text's frames in plain Python."""
    size, frame = max(192, -(-len(text) // 192) * 192), min(3072, max(192, -(-len(text) // 192) * 192))
    counts = [[0] * 32 for _ in range(-(-size // frame))]
    for i, b in enumerate(text):
        counts[i // frame][b // 8] += 1
    starts, recent = [0], []
    for i in range(1, len(counts)):
        n, m = sum(counts[i - 1]), sum(counts[i])
        if m:
            d = sum(abs(a / n - b / m) for a, b in zip(counts[i - 1], counts[i])) / 2
            mean = sum(recent[-8:]) / max(1, len(recent[-8:]))
            spread = (sum((x - mean) ** 2 for x in recent[-8:]) / max(1, len(recent[-8:]))) ** 0.5
            limit = (max(0.25, mean + 3 * spread) if len(recent) >= 3 else 0.5) + (32 / (2 * math.pi * m)) ** 0.5
            recent = [*recent, d]
            if d > limit:
                starts, recent = [*starts, i], []
    found = zip(starts, [*[s - 1 for s in starts[1:]], len(counts) - 1])
    return f"fps=25;frames={len(counts)};shots=" + ",".join(f"{a}-{b}@{40 * a}-{40 * (b + 1)}ms" for a, b in found)


def test_media(spark, docs, none):
    r = random.Random(7)
    junk = "".join(r.choice("0123456789+/=") for _ in range(9000))
    more = [(200, prose(600)), (201, prose(1500) + junk), (202, junk + prose(3000) + junk[:3500]), (203, "x" * 3073), (204, prose(620)[:3080]), (205, (prose(900)[:3072] + "é" * 1500) * 3)]
    rows, frame = ROWS + more, docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    got = {r.doc_id: r for r in avi.probe_media(avi.store(frame)).where("doc_id is not null and doc_id <> 7").collect()}
    for d, t in rows:
        if d in got:
            data = (t or "").encode()
            p = avi.pad(data)
            r = got[d]
            assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))
            assert r.media_sha256 == hashlib.sha256(avi.write(p, r.n_bytes)).hexdigest() and r.feature == brute_shots(data)
            assert r.feature.endswith(",".join(f"{c.first_frame}-{c.last_frame}@{c.start_ms}-{c.end_ms}ms" for c in r.clips))
    assert [len(got[d].clips) for d in (10, 200, 201, 203, 204)] == [1, 1, 2, 1, 1] and len(got[202].clips) >= 3
    clips = avi.clips(avi.store(frame)).where("doc_id = 202").orderBy("clip").collect()
    assert [(c.first_frame, c.end_ms) for c in clips] == [(c.first_frame, c.end_ms) for c in got[202].clips] and avi.store(none).count() == 0


@pytest.mark.parametrize("n", [100, 3070, 3073, 3264, 6200, 20000])
def test_homogeneous_text_is_one_shot(n):
    text = prose(6000)[:n].encode()
    assert len(avi.media(avi.write(avi.pad(text), n))[1]) == 1


def labelled(spark, n=240):
    r = random.Random(9)
    rows, labels = [], []
    for i in range(n):
        toxic, good = int(i % 6 == 0), int(i % 4 != 0)
        text = ". ".join(prose(9, r) for _ in range(4)) + (". you utter scum of it" if toxic else "")
        rows.append((i, text if good else text.upper().replace(" ", "!! ")))
        labels.append((i, good, toxic))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*labels, (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")


def test_toxicity(spark, docs, none):
    train, labels = labelled(spark)
    model = toxicity.fit(train, labels)
    got = toxicity.score(train, model).join(labels.where("toxic is not null"), "doc_id").collect()
    held = [r for r in got if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert np.mean([r.predicted == r.toxic for r in held]) >= 0.9
    spotted = [" ".join(r.offending).lower() for r in got if r.toxic and r.predicted]
    assert np.mean([any(w in x for w in ("you", "utter", "scum", "of", "it")) for x in spotted]) >= 0.9
    out = toxicity.score(docs, model, keep=["source", "text"]).collect()
    assert len(out) == len(ROWS) and all(0 <= r.score <= 1 for r in out) and sorted(x.kept_1 or "" for x in out) == sorted(t or "" for _, t in ROWS)
    assert toxicity.score(none, model).count() == 0
    again = toxicity.fit(train.repartition(7), labels.repartition(3))
    assert np.allclose(model.weights, again.weights) and model.bias == pytest.approx(again.bias)
    assert 0 <= toxicity.score(docs, toxicity.fit(train, labels.limit(0))).first().score <= 1


def brute_toxicity(model, text):
    """The noisy-or of a text's sentences in plain Python, from the trained weights."""
    clean, sentence, left, any_word = 1.0, 0.0, False, False
    for line in (text or "").split("\n"):
        for token in line.split():
            word = token.strip(toxicity.EDGE).lower()
            tail = token[len(token.rstrip(toxicity.EDGE)) :]
            for x in (word, *(word[:n] + "-" for n in toxicity.PREFIX if len(word) > n)):
                if x:
                    sentence += float(model.weights[zlib.crc32(x.encode()) % toxicity.BUCKETS + 1])
                    any_word = True
            left = True
            if any(x in tail for x in ".!?…"):
                clean /= 1 + math.exp(min(700, sentence + model.bias))
                sentence, left = 0.0, False
        if left or line != (text or "").split("\n")[-1]:
            clean /= 1 + math.exp(min(700, sentence + model.bias)) if left else 1.0
            sentence, left = 0.0, False
    return 1 - clean if any_word else model.empty


def test_toxicity_scores_equal_plain_python(spark, docs):
    """Texts without blank lines, whose sentences are those of words alone."""
    train, labels = labelled(spark)
    model = toxicity.fit(train, labels)
    for r in toxicity.score(train, model, keep=["text"]).collect():
        assert r.score == pytest.approx(brute_toxicity(model, r.kept_0), abs=1e-4)
    for r in toxicity.score(docs.where("text is null or not text rlike '\\n'"), model, keep=["text"], sentences=False).collect():
        assert r.score == pytest.approx(brute_toxicity(model, r.kept_0), abs=1e-4) and r.offending is None


def brute_quality(model, text):
    """The score by the compressed sizes of all blocks, in plain Python."""
    data, sizes = (text or "").encode(), []
    for dictionary in (model.good, model.bad):
        coder = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary), write_content_size=False, write_checksum=False, write_dict_id=False)
        sizes.append(sum(len(coder.compress(data[i : i + 1024])) for i in range(0, len(data), 1024)))
    n = len(data) + 100 if data else 1
    d, r, m = 10 * (sizes[1] - sizes[0]) / n, sizes[0] / n, math.log1p(len(data)) / 10
    z = sum(w * x for w, x in zip(model.curve, [1, d, r, m, d * d, r * r, m * m, d * r, d * m, r * m, d**3], strict=True))
    return 1 / (1 + math.exp(-max(-30, min(30, z))))


def test_quality_scores_equal_plain_python(spark, docs):
    train, labels = labelled(spark)
    model = compress_quality.fit(train, labels)
    rows = train.unionByName(docs.where("doc_id is not null and doc_id <> 7").selectExpr("doc_id + 10000 as doc_id", "text"))
    texts = {r.doc_id: r.text for r in rows.collect()}
    for r in compress_quality.score(rows, model).collect():
        assert r.score == pytest.approx(brute_quality(model, texts[r.doc_id]), abs=1e-9) and r.predicted == (r.score >= 0.7)


def test_quality(spark, docs, none):
    train, labels = labelled(spark)
    model = compress_quality.fit(train, labels)
    got = compress_quality.score(train, model).join(labels.where("quality is not null"), "doc_id").collect()
    assert np.mean([r.predicted == r.quality for r in got if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]) >= 0.9
    assert len(compress_quality.score(docs, model).collect()) == len(ROWS) and compress_quality.score(none, model).count() == 0
    assert compress_quality.score(docs, compress_quality.fit(train, labels.limit(0))).first().score == 0.5
    few = compress_quality.fit(train, labels, most=20_000)
    assert few.constant is None and len(few.good) < len(model.good) and compress_quality.fit(train, labels, most=10).constant == 0.5


@pytest.mark.parametrize("min_docs", [2, 3])
def test_line_dedup(docs, none, min_docs):
    out = log_templates.dedup_lines(docs, min_docs=min_docs)
    assert out.columns == [*docs.columns, "___n_lines", "___n_dropped"]
    assert {(r["a.b"], r["__n_lines"], r["`q`"]) for r in out.collect()} == {(10, 11, 22)} and log_templates.digest(out).columns[1:3] == ["n_lines", "n_dropped"]
    same([(r.doc_id, r.text) for r in out.collect()], zip([d for d, _ in ROWS], log_templates.brute_force(ROWS, min_docs), strict=True))
    assert log_templates.dedup_lines(none).count() == 0


def test_line_dedup_on_templates(spark):
    r = random.Random(4)
    rows = [(i, "\n".join([f"user logged in from host {i} named {r.choice(WORDS)} at noon today ok", prose(8, r), "Licensed under terms"])) for i in range(40)]
    got = {x.doc_id: x.text for x in log_templates.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = dict(zip([d for d, _ in rows], log_templates.brute_force(rows), strict=True))
    assert got == want and "Licensed" in got[0] and all("Licensed" not in got[i] and "logged" not in got[i] for i in range(1, 40))


def test_line_dedup_generalises_beyond_the_tree(spark):
    rows = [(i, f"a b c {w} e f g h") for i, w in enumerate(WORDS[:30])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = log_templates.templates(df, log_templates.line_rows(df)).collect()
    assert len(found) == 30 and len({r.template for r in found}) == 1


def test_line_dedup_of_two_documents(spark):
    """A passage of over 50 words in exactly two documents goes from the second, by the default threshold."""
    r = random.Random(6)
    rows = [(i, f"{prose(60, r)}\n{PASSAGE}" if i in (3, 7) else prose(60, r)) for i in range(10)]
    got = {x.doc_id: x.text for x in log_templates.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(PASSAGE.split()) > 50 and got == dict(rows) | {7: rows[7][1].split("\n")[0]}


def test_line_dedup_of_a_large_leaf(spark):
    """5,400 lines of one leaf, with one template that varies in its fourth token and many that don't recur."""
    letters = "abcdefghijklmnopqrst"
    word = lambda i: "".join(letters[i // 20**j % 20] for j in range(4))
    rows = [(i, f"a b c {word(i)} e f g h\na b c {word(3 * i)} {word(5 * i)} {word(7 * i)} g h") for i in range(2700)]
    rows += [(3000 + i, f"a b c {word(i)} {word(i + 1)} {word(i % 50)} g h") for i in range(100)]
    want = log_templates.brute_force(rows)
    got = log_templates.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    same([(r.doc_id, r.text) for r in got], zip([d for d, _ in rows], want, strict=True))
    assert sum("e f g h" in r.text for r in got) == 1 and len({h for _, t in rows for h in t.split("\n")}) > 5000


@pytest.mark.parametrize("size", [1, 2, 3, 4, 5, 8, 9, 13, 40])
def test_leaf_by_blocks(monkeypatch, size):
    r = random.Random(size)
    base = [[r.randrange(2, 9) for _ in range(size)] for _ in range(60)]
    made = [[x if r.random() < 0.75 else r.randrange(2, 9) for x in r.choice(base)] for _ in range(1500)]
    tokens = [np.array(x, "<u4").tobytes() for x in made]
    found = []
    for scanned in (0, 10, 10_000):
        monkeypatch.setattr(log_templates, "SCANNED", scanned)
        found.append(log_templates.parse_leaf(list(range(1500)), tokens))
    assert found[0] == found[1] == found[2]


@pytest.mark.parametrize("limit", [1 << 40, 9000, 300, 1])
def test_sharding(docs, none, limit):
    out = extendible.assign_shards(docs, limit, keep=["source"]).collect()
    same([(r.doc_id, r.n_bytes) for r in out], [(d, len((t or "").encode())) for d, t in ROWS])
    total = {}
    for r in out:
        total.setdefault(r.shard, []).append(r.n_bytes)
    for r in out:
        assert r.shard_bytes == sum(total[r.shard]) and r.shard_docs == len(total[r.shard])
        assert r.shard_bytes <= limit or r.shard_docs == 1
    names = [s.split("/")[0] for s in total]
    assert not any(a != b and b.startswith(a) for a in set(names) for b in set(names))
    assert extendible.assign_shards(none, limit).count() == 0


def test_sharding_of_a_hot_row(spark, tmp_path):
    """A third of all rows are copies of one row."""
    df = spark.createDataFrame([(1, "x" * 100)] * 60 + [(i, "y" * 100) for i in range(2, 122)], "doc_id long, text string").repartition(5)
    out = extendible.assign_shards(df, 1000).collect()
    assert len(out) == 180 and all(r.shard_bytes <= 1000 for r in out) and len({r.shard for r in out if r.doc_id == 1}) >= 6
    extendible.write_shards(df, str(tmp_path / "s"), 1000)
    assert spark.read.parquet(str(tmp_path / "s")).count() == 180


def brute_winnow(rows, items):
    lower = str.maketrans(winnow.UPPER, winnow.LOWER)
    cut = lambda t: re.findall(winnow.WORD, (t or "").translate(lower))
    windows = {}
    for i, t in items:
        w = cut(t)
        for a in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[a : a + 13]), set()).add(str(i))
    sizes, out = {len(w) for w in windows}, []
    for d, t in rows:
        w = cut(t)
        hit, found = set(), set()
        for n in sizes:
            for a in range(len(w) - n + 1):
                if tuple(w[a : a + n]) in windows:
                    hit.update(range(a, a + n))
                    found |= windows[tuple(w[a : a + n])]
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return out


@pytest.mark.parametrize("broadcast", [0, 200_000])
def test_winnowing(spark, docs, none, monkeypatch, broadcast):
    monkeypatch.setattr(winnow, "BROADCAST", broadcast)
    words = PASSAGE.split()
    items = [(1, " ".join(words[5:18])), (2, PASSAGE.upper()), (3, "two spaces"), (4, None), (5, ""), (6, "a a a"), (10, "a a a"), (7, " ".join(words[30:42])), (8, prose(40)), (9, "tiny")]
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, ka int")
    got = winnow.decontaminate(docs, bench).drop("ka", "kb").collect()
    want = brute_winnow(ROWS, items)
    same(got, want)
    assert any(r.contaminated for r in got) and winnow.decontaminate(none, bench).count() == 0
    assert winnow.decontaminate(docs, bench.limit(0)).where("n_hit > 0").count() == 0


def test_words(spark):
    """The pattern in use gives the words of the pattern as it is defined."""
    texts = ["É é Ÿ İ ŉ", "A-b_c 9\x7f\x80\u00a0x", "日本 語😀 end", "".join(map(chr, range(1, 0x250))), "MiXeD Case'S", "", None, "\U0010ffff \u2028q"]
    lower = str.maketrans(winnow.UPPER, winnow.LOWER)
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = rows.select("i", winnow.words(F.col("text")).alias("w"), F.regexp_count(F.coalesce("text", F.lit("")), F.lit(winnow.WORD_ANY_CASE)).alias("n")).collect()
    for r in got:
        assert r.w == re.findall(winnow.WORD, (texts[r.i] or "").translate(lower)) and r.n == len(r.w)


def test_winnowing_of_items_without_id(spark, docs):
    """Their windows hit; they count as one item, as the SQL has it."""
    items = [(None, PASSAGE), (None, "tiny"), (4, "two spaces"), (5, " ".join(PASSAGE.split()[5:18]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = winnow.decontaminate(docs, bench).drop("ka", "kb").collect()
    con = duckdb.connect()
    for name, key, rows in (("documents", "doc_id", ROWS), ("benchmark", "item_id", items)):
        con.execute(f"create table {name} ({key} bigint, text varchar)")
        con.executemany(f"insert into {name} values (?, ?)", rows)
    same(got, con.execute(winnow.ORACLE).fetchall())
    by_id = {r.doc_id: r for r in got}
    assert by_id[5].n_hit == 70 and by_id[5].contaminated and by_id[5].n_items == 2 and by_id[11].contaminated and by_id[11].n_items == 1


@pytest.mark.parametrize(("mean", "bits"), [(256, 1 << 26), (24, 1 << 26), (24, 64)])
def test_chunk_bpe(docs, none, mean, bits):
    """By chunks of the size in use, by small ones, and with a filter that knows everything."""
    lib, want = load(WORD), []
    for d, t in ROWS:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        text = lib.decode(ids, skip_special_tokens=False)
        want.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    got = chunk_bpe.encode_decode(docs, WORD, mean=mean, most=bits, share=0.2 if mean == 256 else 0.0).collect()
    same([r[:4] for r in got], want)
    if mean == 24:
        shared = [r for r in got if r.doc_id in (5, 7) and r.n_tokens > 50]
        assert all(r.n_reused > r.n_tokens // 2 for r in shared) and (bits == 64 or not any(r.n_reused for r in got if r.doc_id in (8, 11, 16)))
    full = chunk_bpe.encode_decode(docs, WORD, payloads=True, mean=mean, share=0.1).collect()
    same([(r.doc_id, len(r.ids) // 4, hashlib.sha256(bytes(r.ids)).hexdigest(), hashlib.sha256(r.decoded.encode()).hexdigest()) for r in full], want)
    assert chunk_bpe.encode_decode(none, WORD).count() == 0


def brute_components(rows):
    fp = [simhash_vp.fingerprint((t or "").encode()) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (fp[i] ^ fp[j]).bit_count() <= 4:
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    low = {g: min((r[0] for r, x in zip(rows, group, strict=True) if x == g and r[0] is not None), default=None) for g in group}
    return [(r[0], f"{f:016x}", low[g]) for r, f, g in zip(rows, fp, group, strict=True)]


@pytest.mark.parametrize(("shard", "leaf"), [(8192, 128), (8192, 4), (3, 2)])
def test_simhash(spark, docs, none, monkeypatch, shard, leaf):
    """With one shard a tree, with deep trees in the shards, and with many shards that visitors cross."""
    base = prose(400).split()
    r = random.Random(2)
    near = [(100 + i, " ".join([*base[: (at := r.randrange(400))], "changed", *base[at + 1 :]])) for i in range(60)]
    rows = [*ROWS, *near]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    plain = simhash_vp.links
    monkeypatch.setattr(simhash_vp, "links", lambda nodes: plain(nodes, shard=shard))
    monkeypatch.setattr(simhash_vp, "LEAF", leaf)
    want = brute_components(rows)
    same(simhash_vp.near_duplicates(df).collect(), want)
    assert len({w[2] for w in want if (w[0] or 0) >= 100}) < 60
    out = simhash_vp.near_duplicates(docs, keep=["ka", "a.b"])
    assert out.columns[3:] == ["class_fp", "kept_0", "kept_1"] and simhash_vp.near_duplicates(none).count() == 0


def test_simhash_trees_at_work(spark):
    """Over the documents of sf0.01 the trees split nodes, and their links are those of every pair compared."""
    path = "/root/testdata/sf0.01/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("the test tables aren't here")
    found = simhash_vp.fingerprints(spark.read.parquet(path)).select("fp").distinct()
    x = np.array([r.fp for r in found.collect()], np.int64).view(np.uint64)
    every, split = np.arange(len(x)), 0
    a, b = simhash_vp.Forest(len(x)), simhash_vp.Forest(len(x))
    for mask in simhash_vp.parts():
        split += simhash_vp.vantage_links(x, every, every[:0], a, mask, 1)
    simhash_vp._compare(x, every, every, b)
    assert split > 20 and (a.roots() == b.roots()).all() and len(set(a.roots().tolist())) < len(x)
    edges = simhash_vp.links(found, shard=100).collect()
    c = simhash_vp.Forest(len(x))
    place = {int(v): i for i, v in enumerate(x.view(np.int64).tolist())}
    c.link(np.array([place[e.u] for e in edges]), np.array([place[e.v] for e in edges]))
    assert (c.roots() == b.roots()).all()


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 200)] + [(500, 400), (7, 7)], "u long, v long").repartition(4)
    got = {r.node: r.root for r in simhash_vp.components(edges).collect()}
    assert got == {i: 0 for i in range(201)} | {400: 400, 500: 400}


@pytest.mark.parametrize("most", [0, 10_000])
def test_components_by_rounds_and_without(spark, most):
    r = random.Random(5)
    pairs = [(i, i + 1) for i in range(300)] + [(r.randrange(1000, 1400), r.randrange(1000, 1400)) for _ in range(250)] + [(-(1 << 63), -5), ((1 << 63) - 1, -5), (7, 7), (2, 1)]
    group = {x: x for p in pairs if p[0] != p[1] for x in p}
    for _ in group:
        before = dict(group)
        for u, v in pairs:
            if u != v:
                group[u] = group[v] = min(group[u], group[v])
        if group == before:
            break
    rows = simhash_vp.joined(spark.createDataFrame(pairs, "u long, v long").repartition(5), most=most).collect()
    assert len(rows) == len(group) and {x.node: x.root for x in rows} == group
    assert simhash_vp.joined(spark.createDataFrame([], "u long, v long"), most=most).count() == 0


@pytest.mark.parametrize("most", [0, None])
def test_simhash_writes_no_round_of_few_edges(spark, monkeypatch, most):
    """Copies with a word changed make a few edges, which go through one file set, not one a round; by rounds the rows are the same."""
    base, tags = prose(300).split(), []
    rows = [(i, " ".join([*base[: 5 * i], "changed", *base[5 * i + 1 :]])) for i in range(40)]
    plain = simhash_vp.materialize
    monkeypatch.setattr(simhash_vp, "materialize", lambda df, tag: tags.append(tag) or plain(df, tag))
    if most is not None:
        monkeypatch.setattr(simhash_vp, "EDGES", most)
    same(simhash_vp.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect(), brute_components(rows))
    assert tags.count("edges") == 1 if most is None else tags.count("edges") > 2
