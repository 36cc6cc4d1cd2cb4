"""Operator 2: removal of repeated byte strings by suffix arrays.

Every byte covered by a string of ``SPAN`` bytes that also starts anywhere else (same document included) goes;
strings are judged on the input. All distinct strings that can be equal meet in one shard:

1. Each window of SPAN bytes has a minimiser, the leftmost k-gram of least hash in it. Neighbouring windows with the
   same minimiser form a stretch; equal windows lie in stretches of equal minimiser. Stretches (about one in 85
   bytes) move as hashes only, and those whose minimiser occurs once are dropped, by counts aggregated before the
   shuffle and a join that can split hot keys.
2. Of equal stretches one text goes to the minimiser's shard, with the number of times that it occurs.
3. A shard of such texts is sorted by induced sorting (suffix.py). Equal windows are neighbours in suffix order, and
   the common prefixes of neighbours, in text order, tell which windows occur twice; so do all windows of a text
   that occurs twice itself.
4. The windows found are brought back to the documents by hash joins, and their union is cut out.

Equal windows have the minimiser at the same place. A minimiser with more than ``SPLIT`` bytes of distinct texts is
therefore split: its windows fall into 2, 4 or 8 classes by that place, the windows of a class share the bytes that
all of them have around the minimiser if they are equal, and each such string of bytes has a shard of its own. Equal
texts of a class are counted before the shuffle and go there once. The shards are sorted in the same way.

Stretches are identified by two 64-bit hashes. Texts are UTF-8, null is empty; texts under SPAN bytes stay whole;
rows equal in doc_id and text are separate occurrences; an empty table gives no rows. What is left may be cut inside
a character, so it is returned as bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary_texts, column, discard, materialize, row_keys
from .suffix import common_prefixes, suffix_array

SPAN, GRAM = 200, 32
#: Bytes sorted together; bytes of a minimiser's texts above which it is split, and into how many classes (a power of two).
SHARD, SPLIT, LEVELS = 1 << 20, 256 << 10, 3
_TABLE = np.random.default_rng(2).integers(1, 1 << 63, 256, dtype=np.uint64)
_LOW = np.uint64(0xFFFFFFFF)


def gram_hashes(data: np.ndarray, size: int = GRAM) -> np.ndarray:
    """A hash of each ``size`` (a power of two) consecutive bytes."""
    h, width, factor = _TABLE[data], 1, 0xD6E8FEB86659FD93
    while width < size:
        h = h[:-width] * np.uint64(factor) + h[width:]
        factor, width = factor * factor & 0xFFFFFFFFFFFFFFFF, 2 * width
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def stretches(data: np.ndarray, span: int = SPAN) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a text of at least span bytes: start, windows, minimiser's place after the start, and minimiser of each stretch."""
    h = gram_hashes(data)
    x = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64)
    wide, width = span - GRAM + 1, 1
    while 2 * width <= wide:
        x = np.minimum(x[:-width], x[width:])
        width *= 2
    if width < wide:
        x = np.minimum(x[: len(x) - (wide - width)], x[wide - width :])
    at = (x & _LOW).astype(np.int64)
    start = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    return start, np.diff(np.append(start, len(at))), at[start] - start, h[at[start]]


def _emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (ka, kb, text): a row for each stretch."""
    for batch in batches:
        index, numbers, minis, digests = [], [], [], []
        for i, text in enumerate(binary_texts(batch.column(2))):
            if len(text) < SPAN:
                continue
            start, count, off, mini = stretches(np.frombuffer(text, np.uint8))
            index.append(np.full(len(start), i))
            numbers.append(np.stack([start, count, off]))
            minis.append(mini)
            view = memoryview(text)
            digests += [xxhash.xxh3_64_intdigest(view[a : a + n + SPAN - 1]) for a, n in zip(start.tolist(), count.tolist(), strict=True)]
        if index:
            take, places = pa.array(np.concatenate(index)), np.concatenate(numbers, axis=1).astype(np.int32)
            hashes = [pa.array(x.view(np.int64)) for x in (np.concatenate(minis), np.array(digests, np.uint64))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), *map(pa.array, places), *hashes], ["ka", "kb", "start", "n", "off", "mini", "digest"])


def classes(text: bytes, start: int, n: int, off: int, level: int) -> Iterator[tuple[int, int, int]]:
    """Of a stretch: the shard, first window and number of windows of each of its 2 ** level classes that has any."""
    at, room, many = start + off, SPAN - GRAM, 1 << level
    for c in range(many):
        low, high = -(-c * (room + 1) // many), -(-(c + 1) * (room + 1) // many) - 1  # of the minimiser's place in the window
        first, last = max(0, off - high), min(n - 1, off - low)
        if first <= last:
            yield xxhash.xxh3_64_intdigest(text[at - low : at - high + SPAN], 8 * level + c) - (1 << 63), first, last - first + 1


TEXTS = "shard long, part long, mini long, digest long, first int, many boolean, body binary"


def _texts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (doc_id, text, wanted): the text of each stretch that is wanted, or of its classes; shard and part name a text."""
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary()]
    for batch in batches:
        rows: list[tuple] = []
        for text, wanted in zip(binary_texts(batch.column(1)), batch.column(2).to_pylist(), strict=True):
            for w in wanted:
                start, n, mini, digest, many = w["start"], w["n"], w["mini"], w["digest"], w["many"]
                if not w["level"]:
                    rows.append((mini, digest, mini, digest, 0, many, text[start : start + n + SPAN - 1]))
                    continue
                for shard, first, k in classes(text, start, n, w["off"], w["level"]):
                    body = text[start + first : start + first + k + SPAN - 1]
                    rows.append((shard, xxhash.xxh3_64_intdigest(body) - (1 << 63), mini, digest, first, many, body))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], [x.split()[0] for x in TEXTS.split(", ")])


def repeated_windows(bodies: list[bytes], many: list[bool] | None = None, span: int = SPAN) -> list[np.ndarray]:
    """Which windows of each text also start elsewhere in these texts, by a suffix array; many: the texts that occur twice."""
    sizes = np.array([len(b) for b in bodies])
    ends = np.cumsum(sizes + 1)  # one separator after each text
    starts = ends - sizes - 1
    symbols = np.ones(int(ends[-1]) + 1, np.uint16)
    symbols[-1] = 0
    data = np.frombuffer(b"\0".join(bodies) + b"\0" + b"\0" * (span + 8), np.uint8)
    symbols[:-1] = data[: len(symbols) - 1].astype(np.uint16) + 2
    symbols[ends - 1] = 1
    opens = np.zeros(len(symbols), bool)  # where a window starts
    marks = np.zeros(len(symbols) + 1, np.int32)
    marks[starts] += 1
    marks[starts + np.maximum(sizes - span + 1, 0)] -= 1
    opens = np.cumsum(marks)[:-1] > 0
    order = suffix_array(symbols, depth=span // 2)  # names are two symbols apart at least
    order = order[opens[order]].astype(np.int64)
    prefix = np.zeros(len(symbols), np.int16)  # of each window with the one before it in suffix order
    same = common_prefixes(data, order[:-1], order[1:], span)
    prefix[order[1:]] = same
    twice = prefix >= span
    twice[order[:-1][same >= span]] = True
    for a, n, often in zip(starts.tolist(), sizes.tolist(), many or [False] * len(bodies), strict=True):
        twice[a : a + n] |= often
    return [twice[a : a + max(0, n - span + 1)] for a, n in zip(starts.tolist(), sizes.tolist(), strict=True)]


def _sorted_shards(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (shard, part, split, many, body) sorted by shard: the windows of each text that repeat (null: all).

    Small shards are sorted together, up to SHARD bytes.
    """

    def close(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        if rows:
            found = repeated_windows([r[4] for r in rows], [r[3] for r in rows])
            out = [(shard, part, split, len(f), None if f.all() else np.packbits(f).tobytes()) for (shard, part, split, _, _), f in zip(rows, found, strict=True) if f.any()]
            kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], ["shard", "part", "split", "count", "windows"])

    ready: list[tuple] = []
    group: list[tuple] = []
    size, group_size, last = 0, 0, None
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[0] != last:
                if size + group_size > SHARD:
                    yield from close(ready)
                    ready, size = [], 0
                ready += group
                size += group_size
                group, group_size, last = [], 0, row[0]
            group.append(row)
            group_size += len(row[4])
    if size + group_size > SHARD:
        yield from close(ready)
        ready = []
    yield from close(ready + group)


def _cut(with_kept: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(5)]
            for text, hits in zip(binary_texts(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                removed = spans = 0
                if hits:
                    marks = np.zeros(len(text) + 1, np.int32)
                    for h in hits:
                        at = h["start"] + h["first"]
                        if h["windows"] is None:
                            marks[at] += 1
                            marks[at + h["count"] + SPAN - 1] -= 1
                        else:
                            at += np.flatnonzero(np.unpackbits(np.frombuffer(h["windows"], np.uint8), count=h["count"]))
                            marks[at] += 1
                            marks[at + SPAN] -= 1
                    gone = np.cumsum(marks[:-1]) > 0
                    removed = int(gone.sum())
                    spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
                    kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
                else:
                    kept = text
                for column, x in zip(out, (len(text), removed, spans, hashlib.sha256(kept).hexdigest(), kept), strict=True):
                    column.append(x)
            kinds, names = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()], ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
            n = 5 if with_kept else 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(out[:n], kinds, strict=False)]], ["doc_id", *names[:n]])

    return run


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", kept: bool = True, split: int = SPLIT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 and, if asked for, kept (the bytes left).

    A minimiser with more than ``split`` bytes of distinct texts is split by classes.
    """
    base = docs.select(*row_keys(key, text), column(key).cast("long").alias("doc_id"), column(text).alias("text"))
    shape = "ka long, kb long, start int, n int, off int, mini long, digest long"
    found = materialize(base.select("ka", "kb", "text").mapInArrow(_emit, shape), "all-stretches")
    minis = materialize(found.groupBy("mini").agg(F.count("*").alias("times")).where("times > 1").select("mini"), "shared-minimisers")
    shared = materialize(found.join(minis, "mini").select(*found.columns), "stretches")  # a hot minimiser's rows split over tasks
    discard(found)
    place = F.min(F.struct("ka", "kb", "start", "n", "off")).alias("place")
    distinct = shared.groupBy("mini", "digest").agg((F.count("*") > 1).alias("many"), place)
    distinct = materialize(distinct.select("mini", "digest", "many", "place.*"), "distinct-stretches")
    halvings = F.least(F.lit(LEVELS), F.ceil(F.log2(F.col("bytes") / split))).cast("int")
    large = distinct.groupBy("mini").agg(F.sum(F.col("n") + SPAN - 1).alias("bytes")).where(F.col("bytes") > split).select("mini", halvings.alias("level"))
    large = materialize(large, "large-minimisers")
    wanted = distinct.join(large, "mini", "left").withColumn("level", F.coalesce("level", F.lit(0)))

    def texts(which: DataFrame) -> DataFrame:
        own = which.groupBy("ka", "kb").agg(F.collect_list(F.struct("start", "n", "off", "mini", "digest", "many", "level")).alias("wanted"))
        return base.join(own, ["ka", "kb"]).select("doc_id", "text", "wanted").mapInArrow(_texts, TEXTS)

    rows, pieces = texts(wanted.where("level = 0")).select("shard", "part", F.lit(False).alias("split"), "many", "body"), None
    if not large.isEmpty():  # classes of different stretches may be the same text, which goes to its shard once
        pieces = materialize(texts(wanted.where("level > 0")), "split-stretches")
        once = pieces.groupBy("shard", "part").agg(((F.count("*") > 1) | F.max("many")).alias("many"), F.first("body").alias("body"))
        rows = rows.unionByName(once.select("shard", "part", F.lit(True).alias("split"), "many", "body"))
    windows = rows.repartition("shard").sortWithinPartitions("shard").mapInArrow(_sorted_shards, "shard long, part long, split boolean, count int, windows binary")
    if pieces is not None:
        windows = materialize(windows, "repeated-windows")
    found = windows.where("not split").select(F.col("shard").alias("mini"), F.col("part").alias("digest"), F.lit(0).alias("first"), "count", "windows")
    if pieces is not None:
        of = pieces.select("shard", "part", "mini", "digest", "first")
        found = found.unionByName(windows.where("split").join(of, ["shard", "part"]).select("mini", "digest", "first", "count", "windows"))
    hits = shared.join(found, ["mini", "digest"]).groupBy("ka", "kb").agg(F.collect_set(F.struct("start", "first", "count", "windows")).alias("hits"))
    out = base.join(hits, ["ka", "kb"], "left").select("doc_id", "text", "hits")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * kept
    return out.mapInArrow(_cut(kept), schema)


def brute_force(texts: list[bytes], span: int = SPAN) -> list[tuple[int, int, bytes]]:
    """(n_removed, n_spans, kept) of each text in plain Python, for tests."""
    seen: dict[bytes, int] = {}
    for t in texts:
        for i in range(len(t) - span + 1):
            seen[t[i : i + span]] = seen.get(t[i : i + span], 0) + 1
    out = []
    for t in texts:
        gone = [False] * len(t)
        for i in range(len(t) - span + 1):
            if seen[t[i : i + span]] > 1:
                gone[i : i + span] = [True] * span
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((sum(gone), runs, bytes(b for b, g in zip(t, gone, strict=True) if not g)))
    return out
