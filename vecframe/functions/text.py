"""The keyword tokenizer."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The English stop words.
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "from", "had", "has", "have", "he", "her", "his", "how",
    "if", "in", "into", "is", "it", "its", "no", "not", "of", "on", "or", "our", "she", "so", "such", "that", "the", "their",
    "them", "then", "there", "these", "they", "this", "to", "was", "we", "were", "what", "when", "which", "who", "will",
    "with", "you",
)
SHORTEST = 2


def tokenize(text: Column) -> Column:
    """Lower-case runs of [a-z0-9], without short ones and stop words; null gives none."""
    runs = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    return F.filter(runs, lambda t: (F.length(t) >= SHORTEST) & ~F.array_contains(stop, t))


def tokenize_one(text: str) -> list[str]:
    """The same for one query text on the driver."""
    return [t for t in re.findall("[a-z0-9]+", text.lower()) if len(t) >= SHORTEST and t not in STOP_WORDS]


def tokenize_lowered(texts: pa.StringArray) -> tuple[np.ndarray, pa.DictionaryArray]:
    """The same for lower-cased texts in a task: the row of each token, and the tokens."""
    spans = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, 4 * texts.offset).astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[spans[0] : spans[-1]]
    spans = spans - spans[0]
    word = (data - np.uint8(97) < 26) | (data - np.uint8(48) < 10)
    first = word.copy()
    first[1:] &= ~word[:-1]
    first[spans[:-1][spans[:-1] < len(data)]] = True
    starts = np.flatnonzero(first & word)
    kept = np.cumsum(word)  # runs stay beside each other without the bytes between them
    offsets = np.append(kept[starts] - 1, kept[-1] if len(kept) else 0).astype(np.int32)
    runs = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data[word].tobytes())).dictionary_encode()
    names = runs.dictionary
    good = pc.and_(pc.greater_equal(pc.binary_length(names), SHORTEST), pc.invert(pc.is_in(names, value_set=pa.array(STOP_WORDS)))).to_numpy(zero_copy_only=False)
    good = good[runs.indices.to_numpy()] if len(names) else np.zeros(0, bool)
    return np.searchsorted(spans, starts[good], "right") - 1, runs.filter(pa.array(good))
