"""Operator 7: quality by compression with two zstandard dictionaries.

One dictionary is trained on good and one on bad labelled text. A text is cut into blocks of ``BLOCK`` bytes, every
block is compressed with either dictionary, and the difference of the sizes, over the text's size, says which
dictionary fits better. A logistic curve over that difference, the compression ratio and the length, fitted on
labelled texts that the dictionaries haven't seen, turns it into a probability.

Fitting takes at most ``ROWS`` labelled documents (see labelled.sample) of ``BYTES`` bytes in all, those with the least
hashes, gathered on the driver: half for the dictionaries, half for the curve. Every text is scored whole. Null and empty texts have difference, ratio and length
0 and get the curve's value there. Without labels of both classes the score is the smoothed rate of label 1.
Repeated rows repeat their result; an empty table gives no rows.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import labelled
from .common import binary_texts, column

ROWS, BYTES = 10_000, 64 << 20
BLOCK, DICTIONARY, LEVEL = 1024, 65_536, 3
#: Bytes added to a text's size where it divides, so that a few bytes' chance doesn't decide on short texts.
SHORT = 100
MODULUS, REMAINDER = 4, 2
THRESHOLD = 0.7


def blocks(data: bytes) -> list[bytes]:
    return [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]


def dictionary(texts: list[bytes]) -> bytes:
    """A zstandard dictionary of the texts; their last bytes as they are where there is too little to train on."""
    parts = [b for t in texts for b in blocks(t)]
    try:
        return zstandard.train_dictionary(DICTIONARY, parts).as_bytes()
    except zstandard.ZstdError:
        return b"".join(parts)[-DICTIONARY:]


@functools.lru_cache(maxsize=4)
def compressor(data: bytes) -> zstandard.ZstdCompressor:
    made = zstandard.ZstdCompressionDict(data)
    made.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(dict_data=made, write_content_size=False, write_checksum=False, write_dict_id=False)


@dataclass
class Model:
    good: bytes
    bad: bytes
    curve: np.ndarray
    constant: float | None = None

    def sizes(self, data: bytes) -> tuple[int, int]:
        good, bad = compressor(self.good).compress, compressor(self.bad).compress
        parts = blocks(data)
        return sum(len(good(x)) for x in parts), sum(len(bad(x)) for x in parts)

    def features(self, data: bytes) -> np.ndarray:
        if not data:
            return features(0.0, 0.0, 0)
        good, bad = self.sizes(data)
        return features((bad - good) / (len(data) + SHORT), good / (len(data) + SHORT), len(data))

    def score(self, x: np.ndarray) -> float:
        return self.constant if self.constant is not None else float(1 / (1 + np.exp(-np.clip(x @ self.curve, -30, 30))))


def features(difference: float, ratio: float, size: int) -> np.ndarray:
    d, r, n = 10 * difference, ratio, np.log1p(size) / 10
    return np.array([1, d, r, n, d * d, r * r, n * n, d * r, d * n, r * n, d**3])


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 30) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(hessian, x.T @ (y - p) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(texts: list[bytes], labels: list[int]) -> Model:
    y = np.array(labels, float)
    half = np.arange(len(y)) % 2 == 0
    if len(y) < 8 or any(y[m].min() == y[m].max() for m in (half, ~half)):
        return Model(b"", b"", np.zeros(11), constant=float((y.sum() + 1) / (len(y) + 2)))
    pick = lambda label: dictionary([t for t, k, h in zip(texts, labels, half, strict=True) if h and k == label])
    model = Model(pick(1), pick(0), np.zeros(11))
    x = np.array([model.features(t) for t, h in zip(texts, half, strict=True) if not h])
    model.curve = logistic(x, y[~half])
    return model


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = ROWS, key: str = "doc_id", text: str = "text", most: int = BYTES) -> Model:
    """Train on at most ``rows`` labelled documents of ``most`` bytes outside the held-out fold."""
    found = labelled.sample(docs, labels, label, rows, MODULUS, REMAINDER, key, text)
    found = found.select(F.xxhash64("doc_id").alias("h"), "doc_id", "label", F.coalesce("text", F.lit("")).cast("binary").alias("t"))
    sizes = found.select("h", "doc_id", F.octet_length("t").alias("n")).orderBy("h", "doc_id", "n").limit(rows).collect()
    kept = int(np.searchsorted(np.cumsum([r.n for r in sizes]), most, side="right"))
    if kept < len(sizes):  # rows of equal hash go together
        found = found.where(F.col("h") < sizes[kept].h)
    found = found.orderBy("h", "doc_id", "t").limit(rows).collect()
    return train([bytes(r.t) for r in found], [r.label for r in found])


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score, predicted (score >= THRESHOLD), difference (normalised, positive: closer to good text)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [model.features(t) for t in binary_texts(batch.column(1))] if model.constant is None else [features(0, 0, 0)] * batch.num_rows
            scores = [model.score(v) for v in x]
            columns = [batch.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= THRESHOLD) for s in scores], pa.int32()), pa.array([float(v[1]) / 10 for v in x], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "score", "predicted", "difference"])

    rows = docs.select(column(key).cast("long").alias("doc_id"), column(text).alias("__text"))
    return rows.mapInArrow(run, "doc_id long, score double, predicted int, difference double")
