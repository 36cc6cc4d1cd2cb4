"""Encoding by cached whitespace-delimited pieces, exact with respect to the tokenizers library.

Both vocabularies split text before merging, and a boundary before a single space that follows a
non-space character is always such a split; so a text's ids are its pieces' ids in a row.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

from .common import RecentCache

#: A space with white space on either side may belong to a longer run.
IRREGULAR = re.compile(r"\s |[ ]\s")
SAFE_CUT = re.compile(r"(?<=\S)(?= \S)")


#: Ahead of a text's first word while its words are cut.
START = "\x00"
#: A word of Latin letters with ASCII punctuation after it: either part is one unit for both vocabularies.
PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]*)([!-/:-@\[-`{-~]*)")


def byte_symbols() -> dict[int, str]:
    """The printable stand-in of each byte that byte-level vocabularies use."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in kept]
    return {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(other)}


SYMBOLS = byte_symbols()


def symbols(text: str) -> str:
    """The text as the vocabulary writes it; of ASCII units only a leading space changes."""
    if text.isascii() and text.isprintable():
        return SYMBOLS[32] + text[1:] if text[0] == " " else text
    return text.encode().decode("latin-1").translate(SYMBOLS)


def load(path: str) -> Tokenizer:
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


#: The same for Arrow.
PLAIN_WORD = r"^(?P<letters>[A-Za-zÀ-ÖØ-öø-ÿ]*)(?P<marks>[!-/:-@\[-`{-~]*)$"


def by_words(texts: list[bytes], unit: Callable[[str], bytes], other: Callable[[str], bytes], space: str = "") -> list[bytes]:
    """Of each text the ids of its words, cut at every space, in a row.

    Plain words are cut into letters and marks, whose ids unit gives (with the space ahead, if there is one), once for
    each that is distinct among the texts; the ids of other words come from other, by the word. All else is Arrow's.
    """
    if not texts:
        return []
    words = pc.split_pattern(pa.array(texts, pa.large_binary()).cast(pa.large_string()), " ")
    coded = words.values.dictionary_encode()
    if not len(coded):
        return [b""] * len(texts)
    cut = pc.extract_regex(coded.dictionary, PLAIN_WORD)
    letters, marks = (pc.fill_null(cut.field(x), "") for x in (0, 1))
    if space:
        bare, (ahead, none) = pc.equal(letters, ""), (pa.scalar(x, pa.large_string()) for x in (space, ""))
        letters, marks = pc.if_else(bare, letters, pc.binary_join_element_wise(ahead, letters, none)), pc.if_else(bare, pc.binary_join_element_wise(ahead, marks, none), marks)
    ids = []
    for part in (letters, marks):
        part = part.dictionary_encode()
        ids.append(pa.array([unit(x) if x else b"" for x in part.dictionary.to_pylist()], pa.large_binary()).take(part.indices))
    found = pc.binary_join_element_wise(*ids, pa.scalar(b"", pa.large_binary()))
    rest = pc.is_null(cut)
    if pc.any(rest).as_py():
        found = pc.replace_with_mask(found, rest, pa.array([other(x) for x in coded.dictionary.filter(rest).to_pylist()], pa.large_binary()))
    _, bounds, data = found.take(coded.indices).buffers()
    at = np.frombuffer(bounds, np.int64, len(coded) + 1)[words.offsets.to_numpy()].tolist()
    data = memoryview(data) if data is not None else memoryview(b"")
    return [bytes(data[a:b]) for a, b in zip(at, at[1:], strict=False)]


class ByteLevelEncoder:
    """Ids of whole texts as bytes of the given dtype, equal to those of ``encode(text, add_special_tokens=False)``.

    Texts that hold the string of an added token go through the library whole. The caches are bounded by
    ``limit`` entries; what they forget is encoded again.
    """

    def __init__(self, path: str, dtype: str = "<u4", limit: int = 600_000):
        self.tokenizer, self.dtype = load(path), dtype
        self.tokenize, self.code = self.tokenizer.model.tokenize, {"<u2": "H", "<u4": "I"}[dtype]
        self.special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.units = RecentCache(self.unit, limit)
        self.first = RecentCache(lambda piece: self.piece(piece, ""), 50_000)
        self.later = RecentCache(lambda piece: self.piece(piece, " "), 2 * limit)

    def unit(self, text: str) -> bytes:
        """Ids of what the splitting leaves whole, by the library's model alone."""
        return array(self.code, [x.id for x in self.tokenize(symbols(text))]).tobytes()

    def piece(self, text: str, space: str) -> bytes:
        """Ids of a piece with the space ahead of it: by its lines' letters and marks, if there is nothing else."""
        if text.isascii() and text.isalpha():
            return self.unit(space + text)  # kept by the piece itself
        out, units = [], self.units
        for n, line in enumerate(text.split("\n")):
            found = PLAIN.fullmatch(line)
            if not found or (n and not line):
                return self.whole(space + text)
            letters, marks = found.groups()
            if n:
                out.append(units["\n"])
            elif letters or marks or space:
                letters, marks = (space + letters, marks) if letters or not marks else (space + marks, "")
            out += [units[x] for x in (letters, marks) if x]
        return b"".join(out)

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def many(self, texts: list[str]) -> list[bytes]:
        """Of each text what calling this gives."""
        out, plain = [b""] * len(texts), []
        for i, text in enumerate(texts):
            if START in text or IRREGULAR.search(text) or any(x in text for x in self.special):
                out[i] = self(text)
            else:
                plain.append(i)
        for i, ids in zip(plain, by_words([(START + texts[i]).encode() for i in plain], self.units.__getitem__, self._word, " "), strict=True):
            out[i] = ids
        return out

    def _word(self, word: str) -> bytes:
        return self.first[word[1:]] if word[:1] == START else self.later[word]

    def __call__(self, text: str) -> bytes:
        if any(x in text for x in self.special):
            return self.whole(text)
        if IRREGULAR.search(text):
            head, *rest = SAFE_CUT.split(text)
            rest = [x[1:] for x in rest]
        else:
            head, *rest = text.split(" ")
        return self.first[head] + b"".join(map(self.later.__getitem__, rest))
