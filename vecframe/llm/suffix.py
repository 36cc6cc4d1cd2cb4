"""Suffix arrays by induced sorting, over whole buckets at a time."""

from __future__ import annotations

import numpy as np


def _types(t: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than the next one (S), False where it is larger (L); the last is S."""
    edge = np.flatnonzero(t[1:] != t[:-1])  # the last position of each run of equal symbols, but the last run's
    rising = np.append(t[edge] < t[edge + 1], True)
    return np.repeat(rising, np.diff(np.concatenate(([-1], edge, [len(t) - 1]))))


def _deal(sa: np.ndarray, symbols: np.ndarray, suffixes: np.ndarray, at: np.ndarray, step: int) -> None:
    """Put suffixes, in order, at the heads (step 1) or tails (step -1) of their symbols' buckets, by a radix pass."""
    order = np.argsort(symbols, kind="stable")  # symbols have 16 bits, for which this is a radix sort
    s = symbols[order]
    first = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
    counts = np.diff(np.append(first, len(s)))
    rank = np.arange(len(s)) - np.repeat(first, counts)
    heads = at[s]
    sa[heads + rank if step > 0 else heads - 1 - rank] = suffixes[order]
    at[s[first]] += step * counts


def _induce(t: np.ndarray, small: np.ndarray, lms: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The suffixes in order, given the leftmost-smaller ones in order."""
    ends = np.cumsum(counts)
    starts = ends - counts
    sa = np.full(len(t), -1, np.int32)
    tails = ends.copy()
    _deal(sa, t[lms][::-1], lms[::-1], tails, -1)
    heads, alphabet = starts.copy(), np.flatnonzero(counts)
    for c in alphabet.tolist():  # larger suffixes, from the left
        low = starts[c]
        while low < heads[c]:
            found = sa[low : heads[c]]
            low = heads[c]
            found = found[found > 0] - 1
            found = found[~small[found]]
            if len(found):
                _deal(sa, t[found], found, heads, 1)
        found = sa[tails[c] : ends[c]]
        found = found[found > 0] - 1
        if len(found):
            _deal(sa, t[found], found, heads, 1)
    tails = ends.copy()
    for c in alphabet[::-1].tolist():  # smaller suffixes, from the right
        if c == 0:
            continue  # the sentinel is alone in its bucket
        high = ends[c]
        while tails[c] < high:
            found = sa[tails[c] : high][::-1]
            high = tails[c]
            found = found[found > 0] - 1
            found = found[small[found]]
            if len(found):
                _deal(sa, t[found], found, tails, -1)
        found = sa[starts[c] : heads[c]][::-1]
        found = found[found > 0] - 1
        found = found[small[found]]
        if len(found):
            _deal(sa, t[found], found, tails, -1)
    return sa


def _order_names(names: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes of the reduced string in order, compared by ``depth`` names at least (all of them, if 0), then by place.

    A rank is where the group of equals starts; a round doubles the names compared, of those that are still equal.
    """
    n, counts = len(names), np.bincount(names)
    rank, width = (np.cumsum(counts) - counts)[names], 1
    tied = np.flatnonzero(counts[names] > 1)
    while len(tied) and width < n and (not depth or width < depth):
        later = np.where(tied + width < n, rank[np.minimum(tied + width, n - 1)] + 1, 0)
        key = rank[tied] * (n + 2) + later
        order = np.argsort(key)
        key, tied = key[order], tied[order]
        own, at = rank[tied], np.arange(len(tied))
        first = np.concatenate(([True], key[1:] != key[:-1]))
        group = np.maximum.accumulate(np.where(np.concatenate(([True], own[1:] != own[:-1])), at, 0))
        rank[tied] = own + np.maximum.accumulate(np.where(first, at, 0)) - group
        size = np.diff(np.append(np.flatnonzero(first), len(tied)))
        tied, width = tied[np.repeat(size > 1, size)], 2 * width
    return np.argsort(rank, kind="stable")


def suffix_array(t: np.ndarray, depth: int = 0) -> np.ndarray:
    """The suffix array of t, whose last symbol is 0 and occurs there only.

    Suffixes are classified, the leftmost-smaller substrings are sorted by one induction and named, the string of
    their names is sorted in turn (by doubling, since its alphabet is large), and a second induction places every
    suffix. With ``depth`` > 0, suffixes that agree in more than 2 * depth symbols may be in any order.
    """
    if len(t) == 1:
        return np.zeros(1, np.int32)
    counts = np.bincount(t)
    small = _types(t)
    lms = np.flatnonzero(small[1:] & ~small[:-1]).astype(np.int32) + 1
    if len(lms) < 2:
        return _induce(t, small, lms, counts)
    is_lms = np.zeros(len(t), bool)
    is_lms[lms] = True
    first = _induce(t, small, lms, counts)
    first = first[is_lms[first]]
    # Name the substrings from each such place to the next, that one included, by length and a polynomial hash.
    size = np.zeros(len(t), np.int64)
    size[lms] = np.append(np.diff(lms) + 1, 1)
    table = np.random.default_rng(7).integers(1, 1 << 63, len(counts), dtype=np.uint64)
    base = np.uint64(0x9E3779B97F4A7C15)
    power = np.ones(len(t) + 1, np.uint64)
    np.multiply.accumulate(np.full(len(t), base), out=power[1:])
    total = np.zeros(len(t) + 1, np.uint64)
    np.cumsum(table[t] * power[:-1], out=total[1:])
    n = size[first]
    # Equal substrings: (total[i + n] - total[i]) scaled to a common power.
    value = (total[first + n] - total[first]) * power[len(t) - first]
    names = np.cumsum(np.concatenate(([False], (n[1:] != n[:-1]) | (value[1:] != value[:-1]))))
    if names[-1] == len(first) - 1:
        return _induce(t, small, first, counts)
    reduced = np.zeros(len(t), np.int64)
    reduced[first] = names
    return _induce(t, small, lms[_order_names(reduced[lms], depth)], counts)


def common_prefixes(data: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Of the byte strings at a and b, the common prefix in whole words of 8, up to ``most`` (a multiple of 8)."""
    words = np.ndarray((len(data) - 7,), "<u8", np.ascontiguousarray(data), strides=(1,))
    out, alive = np.zeros(len(a), np.int64), np.arange(len(a))
    for k in range(0, most, 8):
        alive = alive[words[a[alive] + k] == words[b[alive] + k]]
        if not len(alive):
            break
        out[alive] += 8
    return out
