"""Operator 4: toxicity by multiple-instance learning with noisy-or.

A document is a bag of sentences (ends: ``. ! ?`` after a word, and line ends). A sentence's probability is
logistic in its words and their beginnings (hashed, case and edge punctuation dropped; those that tell the labels apart); a document's is 1 - prod(1 - p): it is toxic if
any sentence is. The weights are trained from document labels only, by full-batch Adam on the likelihood of the
noisy-or; the trained model then locates the offending sentences.

Training takes at most ``rows`` labelled documents (see labelled.sample) whose word numbers are gathered on the
driver; scoring reads every text whole. Null and empty texts have no sentence; they get the rate of label 1 among
training documents without words, or else the lowest score of the model, 0. With no labels, or one class only, the
score is that class's smoothed rate. Repeated rows repeat their result; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import labelled
from .common import RecentCache, column, materialize, slices, worker_cache

ROWS = 12_000
BUCKETS = 1 << 18
PREFIX = (5, 4)
MODULUS, REMAINDER = 5, 0
EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "¿¡«»“”‘’…–—"
BREAK = "\x00"


def numbers(token: str) -> int:
    """The numbers of a token's word and of its first PREFIX letters (19 bits each), and whether it ends a sentence."""
    word = token.strip(EDGE).lower() if token != BREAK else ""
    tail = token[len(token.rstrip(EDGE)) :]
    found = [zlib.crc32(x.encode()) % BUCKETS + 1 for x in (word, *(word[:n] + "-" for n in PREFIX if len(word) > n)) if x]
    return sum(x << 19 * i for i, x in enumerate(found)) | (token == BREAK or any(x in tail for x in ".!?…")) << 57


def tokens(text: str) -> list[str]:
    return text.replace("\n", f" {BREAK} ").split()


def bag(found: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers, three for each token (0 for none), and where each sentence starts among them."""
    cache = worker_cache("toxicity", lambda: RecentCache(numbers, 300_000))
    x = np.fromiter(map(cache.__getitem__, found), np.int64, len(found))
    if not len(x):
        return x.astype(np.int32), x
    starts = np.flatnonzero(x >> 57) + 1
    words = np.stack([x & 0x7FFFF, x >> 19 & 0x7FFFF, x >> 38 & 0x7FFFF], axis=1).ravel()
    return words.astype(np.int32), 3 * np.concatenate(([0], starts[starts < len(x)]))


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    empty: float
    constant: float | None = None

    def sentences(self, words: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The log-odds of each sentence."""
        return np.add.reduceat(self.weights[words], starts) + self.bias

    def score(self, words: np.ndarray, starts: np.ndarray) -> tuple[float, np.ndarray]:
        if not words.any():
            return (self.empty if self.constant is None else self.constant), np.zeros(0)
        z = self.sentences(words, starts)
        return (1 - float(np.exp(-np.logaddexp(0, z).sum())) if self.constant is None else self.constant), z


def informative(seen: np.ndarray, bad: np.ndarray, n: int, n_bad: int) -> np.ndarray:
    """Which word numbers tell the labels apart, from the documents that have each, and those of label 1 among them.

    Those are the ones whose G statistic is over what the best of as many random words has.
    """
    rate, g = n_bad / n, np.zeros(len(seen))
    for k, of, p in ((bad, seen, rate), (seen - bad, seen, 1 - rate), (n_bad - bad, n - seen, rate), (n - n_bad - seen + bad, n - seen, 1 - rate)):
        with np.errstate(divide="ignore", invalid="ignore"):
            g += np.where(k > 0, 2 * k * np.log(k / (of * p)), 0)
    found = g > 2 * np.log(max(2, (seen > 0).sum())) + 4
    found[0] = False
    if not found.any():
        found[np.argsort(-g, kind="stable")[:1000]] = True
        found[0] = False
    return found


def counts(bags: Iterable[np.ndarray], labels: Iterable[int]) -> tuple[np.ndarray, np.ndarray]:
    """For each word number, the documents that have it, and those of label 1 among them."""
    seen, bad = np.zeros(BUCKETS + 1, np.int64), np.zeros(BUCKETS + 1, np.int64)
    for words, y in zip(bags, labels, strict=True):
        own = np.unique(words)
        seen[own] += 1
        bad[own] += y
    return seen, bad


def compact(words: np.ndarray, starts: np.ndarray, telling: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """Sentences (0 if there is no word), the telling words, and the sentence of each."""
    at = np.flatnonzero(telling[words])
    return len(starts) if words.any() else 0, words[at], np.searchsorted(starts, at, side="right") - 1


def train(bags: list[tuple[np.ndarray, np.ndarray]], labels: list[int], **options: float) -> Model:
    """From whole bags, for small samples in memory."""
    if not any(w.any() for w, _ in bags) or len(set(labels)) < 2:
        return train_compact([(1 if w.any() else 0, w[:0], s[:0]) for w, s in bags], labels)
    telling = informative(*counts([w for w, _ in bags], labels), len(labels), sum(labels))
    return train_compact([compact(w, s, telling) for w, s in bags], labels, **options)


def train_compact(rows: list[tuple[int, np.ndarray, np.ndarray]], labels: list[int], steps: int = 200, rate: float = 0.1, decay: float = 2e-6) -> Model:
    wordless = [y for (n, _, _), y in zip(rows, labels, strict=True) if not n]
    empty = (sum(wordless) / len(wordless)) if wordless else 0.0
    kept = [(*r, y) for r, y in zip(rows, labels, strict=True) if r[0]]
    y = np.array([k[3] for k in kept], float)
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(BUCKETS + 1, np.float32), 0.0, empty, constant=float((y.sum() + 1) / (len(y) + 2)))
    sizes = np.array([k[0] for k in kept])
    docs = np.cumsum(sizes) - sizes  # each document's first sentence
    of, total_sentences = np.repeat(np.arange(len(kept)), sizes), int(sizes.sum())
    used, entry = np.unique(np.concatenate([k[1] for k in kept]), return_inverse=True)
    within = np.concatenate([k[2] + at for k, at in zip(kept, docs, strict=True)]).astype(np.int64)
    w, b = np.zeros(len(used)), np.log(max(y.mean(), 1e-3) / max(1, total_sentences / len(kept)))
    mw, vw, mb, vb = np.zeros(len(used)), np.zeros(len(used)), 0.0, 0.0
    for t in range(1, steps + 1):
        z = np.bincount(within, w[entry], total_sentences) + b
        total = np.maximum(np.add.reduceat(np.logaddexp(0, z), docs), 1e-9)
        slope = np.where(y == 1, 1 / np.expm1(np.minimum(total, 50)), -1.0)
        g = slope[of] / (1 + np.exp(-np.clip(z, -50, 50))) / len(kept)
        gw, gb = np.bincount(entry, g[within], len(used)) - decay * w, g.sum()
        mw, vw, mb, vb = 0.9 * mw + 0.1 * gw, 0.99 * vw + 0.01 * gw * gw, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        scale = rate * np.sqrt(1 - 0.99**t) / (1 - 0.9**t)
        w, b = w + scale * mw / (np.sqrt(vw) + 1e-8), b + scale * mb / (np.sqrt(vb) + 1e-8)
    weights = np.zeros(BUCKETS + 1, np.float32)
    weights[used] = w
    return Model(weights, float(b), empty)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = ROWS, key: str = "doc_id", text: str = "text") -> Model:
    """Train on at most ``rows`` labelled documents outside the held-out fold.

    Counts by word are made on the executors; the driver gets one row a word number, then of each sampled document
    the telling words only.
    """

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [bag(tokens(x or "")) for x in batch.column(2).to_pylist()]
            words, starts = (pa.array([x[i].astype("<i4").tobytes() for x in found], pa.binary()) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), words, starts], ["doc_id", "label", "words", "starts"])

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen, bad = counts((np.frombuffer(x, "<i4") for x in batch.column(1).to_pylist()), batch.column(0).to_pylist())
            at = np.flatnonzero(seen)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(seen[at]), pa.array(bad[at])], ["word", "n", "bad"])

    sampled = labelled.sample(docs, labels, label, rows, MODULUS, REMAINDER, key, text).select("doc_id", "label", "text")
    sampled = materialize(sampled.mapInArrow(pack, "doc_id long, label int, words binary, starts binary"), "toxicity-sample")
    n, n_bad = sampled.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    telling = np.zeros(BUCKETS + 1, bool)
    if 0 < n_bad < n:
        by_word = sampled.select("label", "words").mapInArrow(count, "word int, n long, bad long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).toArrow()
        seen, bad = np.zeros(BUCKETS + 1, np.int64), np.zeros(BUCKETS + 1, np.int64)
        at = by_word.column("word").to_numpy()
        seen[at], bad[at] = by_word.column("n").to_numpy(), by_word.column("bad").to_numpy()
        telling = informative(seen, bad, n, n_bad)

    def shrink(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [compact(np.frombuffer(w, "<i4"), np.frombuffer(s, "<i4"), telling) for w, s in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            words, within = (pa.array([x[i].astype("<i4").tobytes() for x in found], pa.binary()) for i in (1, 2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x[0] for x in found], pa.int32()), words, within], ["doc_id", "label", "n", "words", "within"])

    found = sampled.mapInArrow(shrink, "doc_id long, label int, n int, words binary, within binary").collect()
    found.sort(key=lambda r: (r.doc_id, r.n, bytes(r.words), bytes(r.within)))
    return train_compact([(r.n, np.frombuffer(r.words, "<i4"), np.frombuffer(r.within, "<i4")) for r in found], [r.label for r in found])


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", keep: list[str] | None = None, sentences: bool = True) -> DataFrame:
    """doc_id, score, predicted, n_sentences, worst_sentence (its number, from 0) and offending (sentences of p >= 0.5).

    The columns of keep follow, as kept_0, kept_1 and so on; texts go to Python once. Without sentences, offending is null.
    """
    keep = keep or []
    other = [c for c in keep if c != text]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            scores, counts, worst, offending = [], [], [], []
            for text_ in batch.column(1).to_pylist():
                found = tokens(text_ or "")
                words, starts = bag(found)
                p, z = model.score(words, starts)
                scores.append(min(1.0, max(0.0, p)))
                counts.append(len(z))
                worst.append(int(z.argmax()) if len(z) else None)
                ends = [*starts.tolist()[1:], 3 * len(found)]
                bad = [" ".join(x for x in found[starts[i] // 3 : ends[i] // 3] if x != BREAK) for i in np.flatnonzero(z >= 0).tolist()] if sentences else None
                offending.append(bad)
            columns = [batch.column(0), pa.array(scores, pa.float64()), pa.array([int(x >= 0.5) for x in scores], pa.int32()), pa.array(counts, pa.int32()), pa.array(worst, pa.int32()), pa.array(offending, pa.list_(pa.string()))]
            rest = iter(batch.columns[2:])
            kept = [batch.column(1) if c == text else next(rest) for c in keep]
            yield pa.RecordBatch.from_arrays([*columns, *kept], [*names, *[f"kept_{i}" for i in range(len(keep))]])

    names = ["doc_id", "score", "predicted", "n_sentences", "worst_sentence", "offending"]
    rows = docs.select(column(key).cast("long").alias("doc_id"), column(text).alias("__text"), *[column(c).alias(f"__kept_{i}") for i, c in enumerate(other)])
    schema = "doc_id long, score double, predicted int, n_sentences int, worst_sentence int, offending array<string>"
    for i, c in enumerate(keep):
        schema += f", kept_{i} {docs.schema[c].dataType.simpleString()}"
    return rows.mapInArrow(run, schema)
