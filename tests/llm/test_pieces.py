"""Parts that need no Spark session."""

import random
import struct

import numpy as np
import public_tokenizers
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st

from vecframe.llm import avi, compress_quality, jpeg, simhash_vp, substring_dedup, toxicity
from vecframe.llm import chunk_bpe
from vecframe.llm.chunk_bpe import ChunkEncoder, Filter
from vecframe.llm.mph import PerfectHash
from vecframe.llm.suffix import suffix_array
from vecframe.llm.wordcache import ByteLevelEncoder, load

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " ", "  ", "a  b", "a \n b", "\n \n", "x" * 3000 + " " + "y" * 500, "don't 'S <|endoftext|> b", "é́ ŉ", "İI ﬁ x", "日本語 テキスト　空白", "<|startoftext|> hi", "1234 5 6!!", " lead", "trail ", "ß ÿ Ÿ, İ", "word' 's 'll", "_x_ ¨ b", "Σ ΣΑΣ Σ."]
texts = st.text(alphabet=st.sampled_from(list(" \n\tab.,'é1́Σ<|>")), max_size=60)


@pytest.fixture(scope="module")
def coders():
    return ByteLevelEncoder(BYTE), load(BYTE), ChunkEncoder(WORD), load(WORD)


def check(coders, text):
    byte, byte_lib, word, word_lib = coders
    assert byte(text) == np.array(byte_lib.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert byte.many([text, "", text + "\x00", text]) == [byte(x) for x in (text, "", text + "\x00", text)]
    ids = word_lib.encode(text, add_special_tokens=False).ids
    data, want = text.encode(), np.array(ids, "<u4").tobytes()
    assert word.decode(want) == word_lib.decode(ids, skip_special_tokens=False).encode()
    if not word.plain(data):
        assert word.whole(data) == want
        return
    assert word.run(data) == want and word.many([data, b"", data]) == [want, b"", want]
    # Every chunk shared, cut as often as may be.
    plain, word.mean, word.share = chunk_bpe.cut_points, 2, 0.0
    chunk_bpe.cut_points = lambda x, mean: plain(x, mean, 4)
    try:
        parts = word.parts(data, Filter(np.full(1, 0xFFFFFFFFFFFFFFFF, np.uint64)))
    finally:
        chunk_bpe.cut_points, word.mean = plain, 256
    runs = word.runs([p[:2] for p in parts])
    assert b"".join(ids + (word.run(data[a:b]) if digest else b"") for ids, (_, _, digest, a, b) in zip(runs, parts, strict=True)) == want


@pytest.mark.parametrize("text", ODD)
def test_encoders_equal_the_library_on_odd_texts(coders, text):
    check(coders, text)


@settings(max_examples=200, deadline=None)
@given(text=texts)
def test_encoders_equal_the_library(coders, text):
    check(coders, text)


def test_chunks_are_shared_wherever_a_passage_starts():
    code, passage = ChunkEncoder(WORD), " ".join(f"word{i}" for i in range(3000))
    one, two = ({d for _, _, d in code.interiors(x.encode())} for x in ("first " + passage, "another start of it " + passage + " and end"))
    assert len(one) > 20 and len(one - two) <= 2


def test_filter():
    digests = [np.random.default_rng(i).bytes(16) for i in range(500)]
    words = np.zeros(256, np.uint64)
    for d in digests:
        for x in struct.unpack("<qq", d):
            words[(x & 16383) >> 6] |= np.uint64(1) << np.uint64(x & 63)
    known = Filter(words)
    assert all(d in known for d in digests) and sum(np.random.default_rng(i).bytes(16) in known for i in range(1000, 2000)) < 50


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=120))
def test_suffix_array(symbols):
    t = np.array([*symbols, 0], np.uint16)
    assert suffix_array(t).tolist() == sorted(range(len(t)), key=lambda i: t[i:].tolist())


def mixture(seed):
    r = random.Random(seed)
    word = lambda n, a: "".join(r.choice(a) for _ in range(n)).encode()
    parts = [word(r.randint(150, 400), "abcdefgh ") for _ in range(4)]
    docs = [b"".join(r.choice([*parts, word(r.randint(1, 80), "ab ")]) for _ in range(r.randint(1, 5))) for _ in range(8)]
    return docs + [b"a" * r.randint(150, 500), b"xyz" * r.randint(50, 120), b""]


def removed(doc, windows):
    gone = np.zeros(len(doc), bool)
    for i in np.flatnonzero(windows):
        gone[i : i + 200] = True
    return gone.sum()


@pytest.mark.parametrize("seed", range(8))
def test_repeated_windows_equal_brute_force(seed):
    docs = mixture(seed)
    want = [n for n, _, _ in substring_dedup.brute_force(docs)]
    assert [removed(d, f) for d, f in zip(docs, substring_dedup.repeated_windows(docs), strict=True)] == want
    once = sorted(set(docs))
    found = dict(zip(once, substring_dedup.repeated_windows(once, [docs.count(d) > 1 for d in once]), strict=True))
    assert [removed(d, found[d]) for d in docs] == want


@pytest.mark.parametrize("level", [0, 1, 2, 3])
def test_suffix_arrays_decide_every_removed_window(level):
    """By stretches, classes and the suffix array alone, shard for shard."""
    docs = [d for d in mixture(level) if len(d) >= 200]
    shards = {}
    for i, d in enumerate(docs):
        for start, n, off, mini in zip(*(x.tolist() for x in substring_dedup.stretches(np.frombuffer(d, np.uint8))), strict=True):
            for shard, first, k in substring_dedup.classes(d, start, n, off, level) if level else [(mini, 0, n)]:
                shards.setdefault(shard, []).append((i, start + first, d[start + first : start + first + k + 199]))
    windows = [np.zeros(len(d), bool) for d in docs]
    for rows in shards.values():
        for (i, at, _), f in zip(rows, substring_dedup.repeated_windows([b for _, _, b in rows]), strict=True):
            windows[i][at : at + len(f)] |= f
    assert [removed(d, f) for d, f in zip(docs, windows, strict=True)] == [n for n, _, _ in substring_dedup.brute_force(docs)]


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(-(2**63), 2**63 - 1), max_size=300) | st.integers(1, 4000).map(lambda n: set(range(-n, 3 * n, 3))))
def test_perfect_hash(keys):
    keys = np.array(sorted(keys), np.int64)
    found = PerfectHash.load(PerfectHash.build(keys).dump())
    assert sorted(found.slots(keys).tolist()) == list(range(len(keys)))
    foreign = np.array([k for k in range(1000) if k not in set(keys.tolist())])
    assert (found.slots(foreign) < 0).all()
    data = PerfectHash.build(keys).dump()
    assert [PerfectHash.probe(data, int(k)) for k in keys] == found.slots(keys).tolist() and PerfectHash.probe(data, int(foreign[0])) == -1


@pytest.mark.parametrize("text", [b"", b"a", b"hello " * 1000, bytes(range(256)) * 40])
def test_avi_round_trip_by_the_general_decoder_too(text):
    payload = avi.pad(text)
    assert len(payload) % 192 == 0 and len(payload) >= 192
    file = avi.write(payload, len(text))
    assert avi.media(file)[0] == payload
    plane = jpeg.decode(avi.parse(file)["frames"][0])[0]
    first = payload[: avi.FRAME]
    assert plane[::8, ::8].tobytes()[: len(first)] == first and (plane[::8, ::8] == plane[7::8, 5::8]).all()


def test_general_jpeg_decoding_by_symbols():
    """The symbol-by-symbol path gives what the fast one gives."""
    data = bytes(range(192))
    frame = jpeg.encode(data)
    flat = jpeg.Frame.flat
    try:
        jpeg.Frame.flat = lambda self: False
        assert jpeg.decode(frame)[0][::8, ::8].tobytes() == data
    finally:
        jpeg.Frame.flat = flat


def test_shots_are_found_where_histograms_jump():
    dark, light = np.zeros(avi.BINS), np.zeros(avi.BINS)
    dark[0] = light[-1] = 1
    assert avi.shots([1000 * dark] * 5 + [1000 * light] * 4) == [(0, 4), (5, 8)]
    assert avi.shots([1000 * dark] * 5 + [light]) == [(0, 5)] and avi.shots([1000 * dark, 0 * dark]) == [(0, 1)] and avi.shots([]) == []
    frames = [jpeg.encode(bytes([v]) * 192) for v in (1, 1, 250)]
    assert [avi.histogram(jpeg.blocks(f)).argmax() for f in frames] == [0, 0, 31]


def simhash_by_hand(text):
    import re

    import xxhash

    found = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text))
    grams = [" ".join(found[i : i + 4]) for i in range(len(found) - 3)] if len(found) >= 4 else ([" ".join(found)] if found else [])
    h = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet=st.sampled_from(list(" \n\x0b\x1f\xa0abÉÀ.")), max_size=80))
def test_fingerprint(text):
    assert simhash_vp.fingerprint(text.encode()) == simhash_by_hand(text)


def sample(spread):
    rng = np.random.default_rng(spread)
    x = np.unique(rng.integers(0, 1 << spread, 1500).astype(np.uint64))
    near = x[:200] ^ (np.uint64(1) << rng.integers(0, 64, 200).astype(np.uint64))
    return np.unique(np.concatenate([x, near]))


@pytest.mark.parametrize("spread", [12, 40, 62])
def test_vantage_trees_find_the_links_of_brute_force(spread):
    x = sample(spread)
    every = np.arange(len(x))
    a, b, c = (simhash_vp.Forest(len(x)) for _ in range(3))
    assert simhash_vp.vantage_links(x, every, every[:0], a) > 10
    for mask in simhash_vp.parts():
        simhash_vp.vantage_links(x, every, every[:0], c, mask, 1)
    simhash_vp._compare(x, every, every, b, 4)
    assert (a.roots() == b.roots()).all() and (c.roots() == b.roots()).all()


@pytest.mark.parametrize("spread", [12, 62])
def test_linked_fingerprints_meet_at_a_shard(spread):
    x = sample(spread)
    found = set()
    for mask in simhash_vp.parts():
        tree, leaves = simhash_vp.plant(x[::3], mask, 5)
        homes = []
        for leaf, m, v in simhash_vp.route(tree, x, mask, 1):
            assert leaf < leaves
            homes += m.tolist()
            both = np.concatenate([m, v])
            i, j = np.nonzero(np.bitwise_count(x[m][:, None] ^ x[both][None, :]) <= 4)
            found |= {(min(p), max(p)) for p in zip(m[i].tolist(), both[j].tolist())}
        assert sorted(homes) == list(range(len(x)))
    i, j = np.nonzero(np.bitwise_count(x[:, None] ^ x[None, :]) <= 4)
    assert found == {(a, b) for a, b in zip(i.tolist(), j.tolist()) if a <= b}


def test_parts_lose_no_pair():
    r = random.Random(3)
    for _ in range(300):
        x = r.getrandbits(64)
        y = x
        for b in r.sample(range(64), 4):
            y ^= 1 << b
        assert any(((x ^ y) & m).bit_count() <= 1 for m in simhash_vp.parts())


def test_noisy_or_finds_the_sentence():
    clean = [f"the cat sat on mat {i}. it was fine today. all is well" for i in range(60)]
    bad = [f"the cat sat on mat {i}. you are scum. all is well" for i in range(60)]
    bags = [toxicity.bag(toxicity.tokens(t)) for t in clean + bad]
    model = toxicity.train(bags, [0] * 60 + [1] * 60)
    p, z = model.score(*toxicity.bag(toxicity.tokens("the cat sat. you are scum. it was fine")))
    assert p > 0.8 and z.argmax() == 1
    assert model.score(*toxicity.bag(toxicity.tokens("the cat sat on mat. it was fine")))[0] < 0.2
    assert 0 <= model.score(*toxicity.bag([]))[0] <= 1


def test_noisy_or_without_two_classes():
    model = toxicity.train([toxicity.bag(toxicity.tokens("a b"))], [0])
    assert 0 <= model.score(*toxicity.bag(toxicity.tokens("x")))[0] < 0.5
    assert 0 <= toxicity.train([], []).score(*toxicity.bag([]))[0] <= 1


def test_compression_tells_good_from_bad():
    r = random.Random(1)
    words = ["".join(r.choice("etaoinshrdlu") for _ in range(r.randint(2, 7))) for _ in range(300)]
    good = [" ".join(r.choice(words) for _ in range(150)).encode() for _ in range(200)]
    bad = [" ".join(r.choice(words).upper() + "!!" for _ in range(150)).encode() for _ in range(200)]
    mixed = [x for pair in zip(good, bad, strict=True) for x in pair]
    order = r.sample(range(400), 400)
    model = compress_quality.train([mixed[i] for i in order], [1 - i % 2 for i in order])
    scores = [model.score(model.features(t)) for t in (good[0], bad[0])]
    assert scores[0] > 0.9 and scores[1] < 0.1
    assert 0 <= model.score(model.features(b"")) <= 1
    assert compress_quality.train([b"a"], [1]).score(compress_quality.features(0, 0, 0)) > 0.5
    assert isinstance(zstandard.__version__, str)
