"""Operator 9: BPE encoding and decoding with reuse of content-defined chunks.

A text is cut where a rolling hash of the preceding bytes says so, wherever that falls, so that documents that
share passages share chunks. What lies between a chunk's first and last space is its interior.

1. The 128-bit digests of interiors are counted over all documents; only digests are shuffled.
2. A Bloom filter of the digests that occur twice (16 bits for each, ``FILTER`` bits at most) goes to all tasks. A
   text is encoded where it is read, but for the interiors that the filter knows: those are left as references, and
   each task passes their bytes on once. A full filter only makes more interiors references.
3. Each such interior is encoded once, and its ids are joined to the references.
4. The parts of a document meet and give its ids, which are decoded.

A text of which known interiors are less than ``SHARE`` is encoded where it is read all the same: to move the ids of
all the rest of it would cost more than to encode these interiors again.

Joints: at a reference the words on both sides of a chunk's border are joined again and re-encoded as a run. Where a
run meets an interior, the library encodes the words on both sides of the joint together. If that agrees with
their ids apart, the joint holds; else the run grows over the chunk to the next joint, and goes through the library
as a whole. Texts that hold the string of an added token go through the library whole.

Null text is empty: no ids, empty decoded text. Repeated rows give repeated results; other columns are ignored. An
empty table gives no rows. A chunk that a third of all rows hold is one key of a join without an aggregate, which
adaptive execution splits.
"""

from __future__ import annotations

import hashlib
import math
import struct
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import RecentCache, column, materialize, slices, worker_cache
from .wordcache import PLAIN, by_words, load, symbols

WINDOW = 16
#: One position in so many ends a chunk.
MEAN = 256
#: The least part of a text that known interiors must be, to be referred to.
SHARE = 0.2
WORDS, JOINTS = 400_000, 100_000
#: Bits of the largest filter, and digests that a task remembers to have passed on.
FILTER, PASSED = 1 << 26, 200_000
_GEAR = np.random.default_rng(1).integers(0, 1 << 63, 256, dtype=np.uint64)


def cut_points(data: bytes, mean: int = MEAN, window: int = WINDOW) -> list[int]:
    """Ends of content-defined chunks: where the hash of the last ``window`` bytes is 0 modulo mean."""
    if len(data) <= window:
        return [len(data)]
    h, width = _GEAR[np.frombuffer(data, np.uint8)], 1
    while width < window:
        h[width:] += h[:-width] * np.uint64(0x9E3779B97F4A7C15 | 1) ** np.uint64(width)
        width *= 2
    at = np.flatnonzero((h >> np.uint64(40)) % np.uint64(mean) == 0) + 1
    at = at[(at >= window) & (at < len(data))]
    return [*at.tolist(), len(data)]


class Filter:
    """Which digests may occur twice."""

    def __init__(self, words: np.ndarray):
        self.words, self.mask = words, 64 * len(words) - 1

    def __contains__(self, digest: bytes) -> bool:
        for x in struct.unpack("<qq", digest):
            if not int(self.words[(x & self.mask) >> 6]) >> (x & 63) & 1:
                return False
        return True


class ChunkEncoder:
    """Encodes UTF-8 texts to ids (little-endian uint32) and decodes those."""

    def __init__(self, path: str, mean: int = MEAN, share: float = SHARE, words: int = WORDS):
        self.tokenizer, self.mean, self.share = load(path), mean, share
        added = {k: v.content for k, v in self.tokenizer.get_added_tokens_decoder().items()}
        self.special = [x.encode() for x in added.values()]
        self.tokenize = self.tokenizer.model.tokenize
        self.words = RecentCache(self.word, words)
        self.units = RecentCache(self.unit, words)
        self.joints = RecentCache(lambda pair: self.whole(b" ".join(pair)) == self.words[pair[0]] + self.words[pair[1]], JOINTS)
        # Without a decoder the library joins the tokens themselves by spaces.
        known = {i: t for t, i in self.tokenizer.get_vocab().items()}
        self.table = None if self.tokenizer.decoder else [known.get(i, "").encode() for i in range(max(known) + 1)]
        self.narrow = max(known) < 1 << 16

    def whole(self, data: bytes) -> bytes:
        return np.array(self.tokenizer.encode(data.decode(), add_special_tokens=False).ids, "<u4").tobytes()

    def word(self, data: bytes) -> bytes:
        """A word: its letters and its punctuation are units of the vocabulary's splitting; others go through the library."""
        found = PLAIN.fullmatch(data.decode())
        return b"".join([self.units[x] for x in found.groups() if x]) if found else self.whole(data)

    def unit(self, text: str) -> bytes:
        return array("I", [x.id for x in self.tokenize(symbols(text.lower()))]).tobytes()

    def run(self, data: bytes) -> bytes:
        """Words between spaces, none of them an added token."""
        return b"".join(map(self.words.__getitem__, data.split(b" ")))

    def plain(self, data: bytes) -> bool:
        return not any(x in data for x in self.special)

    def interiors(self, data: bytes) -> Iterator[tuple[int, int, bytes]]:
        """Start, end and digest of each chunk's interior."""
        a, view = 0, memoryview(data)
        for b in cut_points(data, self.mean):
            first, last = data.find(b" ", a, b), data.rfind(b" ", a, b)
            if last > first + 1 > 0:
                yield first + 1, last, xxhash.xxh3_128_digest(view[first + 1 : last])
            a = b

    def holds(self, data: bytes, start: int, a: int, b: int) -> bool:
        """Whether the joints on both sides of the interior from a to b hold; start is where the run ahead of it does."""
        left = data[max(start, data.rfind(b" ", start, a - 1) + 1) : a - 1]
        first = data[a : data.find(b" ", a, b) if b" " in data[a:b] else b]
        last, end = data[max(a, data.rfind(b" ", a, b) + 1) : b], data.find(b" ", b + 1)
        return self.joints[left, first] and self.joints[last, data[b + 1 : end if end >= 0 else len(data)]]

    def parts(self, data: bytes, known: Filter) -> list[tuple[bytes, bool, bytes | None, int, int]]:
        """Runs, and whether they are odd, each with the interior that follows it (digest, start, end; none after the last)."""
        out, start, odd = [], 0, False
        found = [x for x in self.interiors(data) if x[2] in known]
        if sum(b - a for a, b, _ in found) < self.share * len(data):
            found = []
        for a, b, digest in found:
            if not self.holds(data, start, a, b):
                odd = True
                continue
            out.append((data[start : a - 1], odd, digest, a, b))
            start, odd = b + 1, False
        out.append((data[start:], odd, None, 0, 0))
        return out

    def many(self, texts: list[bytes]) -> list[bytes]:
        """Of each text what run gives."""
        return by_words(texts, lambda x: self.units[x.lower()], lambda x: self.words[x.encode()])

    def runs(self, texts: list[tuple[bytes, bool]]) -> list[bytes]:
        """Ids of runs; odd ones go through the library whole."""
        plain = iter(self.many([x for x, odd in texts if not odd]))
        return [self.whole(x) if odd else next(plain) for x, odd in texts]

    def decode(self, ids: bytes) -> bytes:
        numbers = np.frombuffer(ids, "<u4").tolist()
        if self.table is None:
            return self.tokenizer.decode(numbers, skip_special_tokens=False).encode()
        return b" ".join(map(self.table.__getitem__, numbers))

    def pack(self, ids: bytes) -> bytes:
        """Ids as they are moved, in two bytes each if the vocabulary allows it."""
        return np.frombuffer(ids, "<u4").astype("<u2").tobytes() if self.narrow else ids

    def unpack(self, ids: bytes) -> bytes:
        return np.frombuffer(ids, "<u2").astype("<u4").tobytes() if self.narrow else ids


def _encoder(tokenizer: str, mean: int, share: float) -> ChunkEncoder:
    return worker_cache(("chunk-bpe", tokenizer, mean, share), lambda: ChunkEncoder(tokenizer, mean, share))


def shared_interiors(texts: DataFrame, tokenizer: str, mean: int = MEAN, share: float = SHARE) -> DataFrame:
    """h1, h2: the digests of interiors that occur twice or more in the texts (column text)."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = _encoder(tokenizer, mean, share)
        for batch in slices(batches):
            found = b"".join(d for x in batch.column(0).cast(pa.binary()).to_pylist() if x and code.plain(x) for _, _, d in code.interiors(x))
            keys, n = np.unique(np.frombuffer(found, "V16"), return_counts=True)
            two = keys.view("<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(two[:, 0]), pa.array(two[:, 1]), pa.array(n.astype(np.int64))], ["h1", "h2", "n"])

    return texts.select("text").mapInArrow(count, "h1 long, h2 long, n long").groupBy("h1", "h2").agg(F.sum("n").alias("n")).where("n > 1").select("h1", "h2")


def filter_of(shared: DataFrame, most: int = FILTER) -> Filter:
    """A filter of the digests; the driver gets its words, ``most`` bits at the most."""
    bits = min(most, 1 << max(6, math.ceil(math.log2(16 * max(1, shared.count())))))
    at = F.explode(F.array(*[F.col(c).bitwiseAND(F.lit(bits - 1)) for c in ("h1", "h2")]))
    found = shared.select(at.alias("b")).groupBy(F.shiftright("b", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b & 63 as int))")).alias("x")).toArrow()
    words = np.zeros(bits // 64, np.uint64)
    words[found.column("w").to_numpy()] = found.column("x").to_numpy().view(np.uint64)
    return Filter(words)


RESULT = "n_tokens long, ids_sha256 string, decoded_sha256 string, n_reused long, ids binary, decoded string"
PARTS = f"kind int, rid long, doc_id long, pos int, run binary, h1 long, h2 long, body binary, {RESULT}"
DONE, PART, BODY = 0, 1, 2


def _result(code: ChunkEncoder, ids: bytes, reused: int, payloads: bool) -> tuple:
    text = code.decode(ids)
    return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text).hexdigest(), reused, ids if payloads else None, text.decode() if payloads else None


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def _schema(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in ddl.split(", "))])


def encode_decode(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", payloads: bool = False, mean: int = MEAN, share: float = SHARE, most: int = FILTER) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, n_reused (ids that came from shared interiors) of every text.

    With payloads also ids (binary) and decoded.
    """
    texts = docs.select(column(key).cast("long").alias("doc_id"), column(text).alias("text"))
    known = filter_of(materialize(shared_interiors(texts, tokenizer, mean, share), "shared-interiors"), most)

    def split(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, schema, passed, nothing = _encoder(tokenizer, mean, share), _schema(PARTS), set(), (None,) * 6
        rid = TaskContext.get().partitionId() << 33
        for batch in slices(batches):
            rows = []
            texts = [x or b"" for x in batch.column(1).cast(pa.binary()).to_pylist()]
            cut = [code.parts(x, known) if code.plain(x) else [(x, True, None, 0, 0)] for x in texts]
            runs = iter(code.runs([p[:2] for parts in cut for p in parts]))
            for doc, x, parts in zip(batch.column(0).to_pylist(), texts, cut, strict=True):
                rid += 1
                if len(parts) == 1:
                    rows.append((DONE, rid, doc, 0, None, None, None, None, *_result(code, next(runs), 0, payloads)))
                    continue
                for pos, (_, _, digest, a, b) in enumerate(parts):
                    ids = next(runs)
                    h1, h2 = struct.unpack("<qq", digest) if digest else (None, None)
                    rows.append((PART, rid, doc, pos, code.pack(ids), h1, h2, None, *nothing))
                    if digest and digest not in passed:
                        passed.add(digest)
                        rows.append((BODY, None, None, None, None, h1, h2, x[a:b], *nothing))
                if len(passed) > PASSED:
                    passed.clear()
            yield _batch(rows, schema)

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = _encoder(tokenizer, mean, share)
        for batch in slices(batches):
            ids = [code.pack(x) for x in code.many(batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.binary())], ["h1", "h2", "inner"])

    def join(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, schema = _encoder(tokenizer, mean, share), _schema(f"doc_id long, {RESULT}")
        for batch in slices(batches):
            rows = []
            for doc, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                parts.sort(key=lambda p: (p["pos"], p["run"] is None))  # an interior comes after its run
                ids = code.unpack(b"".join([y for p in parts for y in (p["run"], p["inner"]) if y]))
                reused = sum(len(p["inner"]) for p in parts if p["inner"]) // (2 if code.narrow else 4)
                rows.append((doc, *_result(code, ids, reused, payloads)))
            yield _batch(rows, schema)

    found = materialize(texts.mapInArrow(split, PARTS), "text-parts")
    encoded = found.where(F.col("kind") == BODY).groupBy("h1", "h2").agg(F.first("body").alias("body")).mapInArrow(encode, "h1 long, h2 long, inner binary")
    parts = found.where(F.col("kind") == PART)
    nothing = F.lit(None).cast("binary")
    inner = parts.where("h1 is not null").select("rid", "doc_id", "pos", "h1", "h2").join(encoded, ["h1", "h2"]).select("rid", "doc_id", "pos", nothing.alias("run"), "inner")
    both = parts.select("rid", "doc_id", "pos", "run", nothing.alias("inner")).unionByName(inner)
    whole = both.groupBy("rid").agg(F.first("doc_id").alias("doc_id"), F.collect_list(F.struct("pos", "run", "inner")).alias("parts"))
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_reused", *(["ids", "decoded"] if payloads else [])]
    done = found.where(F.col("kind") == DONE).select(*names)
    return done.unionByName(whole.select("doc_id", "parts").mapInArrow(join, f"doc_id long, {RESULT}").select(*names))
