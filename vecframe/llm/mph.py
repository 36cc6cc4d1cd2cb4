"""Minimal perfect hashing of 64-bit keys by collision-free levels, with stored fingerprints."""

from __future__ import annotations

import struct

import numpy as np

#: Bits for each of which a rank is stored.
BLOCK = 512


def mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """A bijective scrambling of 64-bit keys (the finaliser of splitmix64)."""
    x = keys.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Maps each of n distinct keys to its own slot in [0, n).

    Level i hashes the keys still unplaced into a bit array; a key alone on its bit is placed there, the
    others go to the next level. A slot is the rank of the key's bit. A 32-bit fingerprint in each slot
    tells foreign keys apart (wrongly with probability 2**-32).
    """

    def __init__(self, levels: list[np.ndarray], fingerprints: np.ndarray):
        self.levels, self.fingerprints = levels, fingerprints
        starts = np.cumsum([0, *(int(x.sum()) for x in levels)])
        self.ranks = [np.cumsum(x, dtype=np.int64) - x + s for x, s in zip(levels, starts[:-1], strict=True)]

    @classmethod
    def build(cls, keys: np.ndarray, gamma: float = 1.6) -> PerfectHash:
        left, levels = np.asarray(keys).astype(np.uint64), []
        if len(np.unique(left)) != len(left):
            raise ValueError("keys must be distinct")
        while len(left):
            size = max(8, int(gamma * len(left)))
            at = (mix(left, len(levels) + 1) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone.astype(np.uint8))
            left = left[~alone[at]]
        out = cls(levels, np.zeros(len(keys), np.uint32))
        out.fingerprints[out.slots(keys, check=False)] = cls.fingerprint(keys)
        return out

    @staticmethod
    def fingerprint(keys: np.ndarray) -> np.ndarray:
        return (mix(np.asarray(keys).astype(np.uint64), 0) >> np.uint64(32)).astype(np.uint32)

    def slots(self, keys: np.ndarray, check: bool = True) -> np.ndarray:
        """The slot of each key, -1 for keys that the fingerprints show to be foreign."""
        keys = np.asarray(keys).astype(np.uint64)
        out, todo = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for i, (level, rank) in enumerate(zip(self.levels, self.ranks, strict=True)):
            at = (mix(keys[todo], i + 1) % np.uint64(len(level))).astype(np.int64)
            hit = level[at] == 1
            out[todo[hit]] = rank[at[hit]]
            todo = todo[~hit]
        if check and len(out):
            ok = out >= 0
            ok[ok] = self.fingerprints[out[ok]] == self.fingerprint(keys[ok])
            out[~ok] = -1
        return out

    def dump(self) -> bytes:
        """Numbers of keys, levels and bits; each level's bits and the ranks at its blocks; fingerprints."""
        out = [struct.pack("<II", len(self.fingerprints), len(self.levels)), *(struct.pack("<I", len(x)) for x in self.levels)]
        for level, rank in zip(self.levels, self.ranks, strict=True):
            out += [np.packbits(level, bitorder="little").tobytes(), rank[::BLOCK].astype("<u4").tobytes()]
        return b"".join(out) + self.fingerprints.astype("<u4").tobytes()

    @staticmethod
    def _places(data: bytes) -> tuple[int, list[tuple[int, int, int]], int]:
        """Keys; bits, and where bits and ranks start, of each level; where fingerprints start."""
        n, k = struct.unpack_from("<II", data)
        at, out = 8 + 4 * k, []
        for size in struct.unpack_from(f"<{k}I", data, 8):
            ranks = at + (size + 7) // 8
            out.append((size, at, ranks))
            at = ranks + 4 * -(-size // BLOCK)
        return n, out, at

    @classmethod
    def load(cls, data: bytes) -> PerfectHash:
        n, places, at = cls._places(data)
        levels = [np.unpackbits(np.frombuffer(data, np.uint8, (size + 7) // 8, bits), count=size, bitorder="little") for size, bits, _ in places]
        return cls(levels, np.frombuffer(data, "<u4", n, at).copy())

    @classmethod
    def probe(cls, data: bytes, key: int) -> int:
        """The slot of one key in what dump wrote, -1 if it is foreign: a bit, a rank and a block a level are read."""
        x, (_, places, prints) = np.array([key]).astype(np.uint64), cls._places(data)
        for i, (size, bits, ranks) in enumerate(places):
            at = int(mix(x, i + 1)[0] % np.uint64(size))
            if data[bits + (at >> 3)] >> (at & 7) & 1:
                block = at // BLOCK
                ahead = int.from_bytes(data[bits + block * (BLOCK // 8) : bits + (at >> 3) + 1], "little") & ((1 << at % BLOCK) - 1)
                slot = struct.unpack_from("<I", data, ranks + 4 * block)[0] + ahead.bit_count()
                return slot if struct.unpack_from("<I", data, prints + 4 * slot)[0] == int(cls.fingerprint(x)[0]) else -1
        return -1
