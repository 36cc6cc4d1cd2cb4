"""Operator 10: SimHash near-duplicates by vantage-point trees.

Fingerprint: words ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z, shingles of four words (repeats included; fewer
words are one shingle; none give 0), XXH64 with seed 42 of each shingle; a bit is set if over half the hashes
set it. Fingerprints that differ in at most four bits are linked; a component is what links reach.

Trees. The bits are cut into PARTS parts; fingerprints within four bits are within one bit in one of three parts, so
each part has a tree of its own, by Hamming distance in that part, and pairs are checked on all 64 bits. (On all
bits a ball of radius 4 crosses 0.7 of a tree's boundaries, as unrelated fingerprints are 32 +- 4 apart; in a part
a ball of radius 1 crosses a third.) A node has a vantage point and a radius: members within the radius go in, the
others out. By the triangle inequality |d(x) - d(y)| <= d(x, y), so only members in the first ring beyond the radius
can be linked to inner ones: they also visit the inner side, and visitors go on to each side that their ball
reaches. Any linked pair so meets at the leaf where one of the two is at home.

The top levels are planted on the driver, from SAMPLE fingerprints, and their leaves are the shards; each shard
continues its tree in memory. Fingerprints that a part can't tell apart are split by the distance on all bits.
The sample only balances the shards; links don't depend on it.

Each task links what it finds by union-find and passes on one edge for each member at most. Up to EDGES of these edges
are joined to components by union-find in one task; more are joined by alternating large and small stars, each round
written to the shared folder. Both give the same components.

Null texts count as empty; all empty texts share fingerprint 0. Repeated rows share their fingerprint. A null
doc_id takes part in links but names no component unless all members are null. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary_texts, column, discard, materialize, slices

RADIUS, PARTS = 4, 3
ALL = (1 << 64) - 1
#: Members of a leaf; fingerprints aimed at in a shard; those that the driver plants trees from, and the trees' levels there.
LEAF, SHARD, SAMPLE, LEVELS = 128, 8_192, 20_000, 14
#: Edges that one task joins to components (16 bytes each); more take the rounds of stars.
EDGES = 500_000


def shingle_hashes(data: bytes, size: int = 4, seed: int = 42) -> list[int]:
    words = data.lower().split()
    if not words:
        return []
    if len(words) <= size:
        return [xxhash.xxh64_intdigest(b" ".join(words), seed)]
    text = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    return [digest(text[a:b], seed) for a, b in zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)]


def fingerprint(data: bytes, size: int = 4) -> int:
    """The SimHash of a UTF-8 text as an unsigned integer."""
    hashes = shingle_hashes(data, size)
    if not hashes:
        return 0
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[at : at + (1 << 16)], "<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = counts * 2 > len(hashes)
    return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 4, keep: list[str] | None = None) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long), and the columns of keep as kept_0, kept_1 and so on."""
    names = [f"kept_{i}" for i in range(len(keep or []))]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = np.array([fingerprint(x, size) for x in binary_texts(batch.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64)), *batch.columns[2:]], ["doc_id", "fp", *names])

    rows = docs.select(column(key).cast("long").alias("doc_id"), column(text).alias("text"), *[column(c).alias(n) for c, n in zip(keep or [], names, strict=True)])
    return rows.mapInArrow(run, "doc_id long, fp long" + "".join(f", {n} {docs.schema[c].dataType.simpleString()}" for c, n in zip(keep or [], names, strict=True)))


class Forest:
    """Union-find over 0..n-1 with whole arrays of links at a time; a root is its set's smallest member."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self) -> np.ndarray:
        while True:
            up = self.parent[self.parent]
            if np.array_equal(up, self.parent):
                return up
            self.parent = up

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            root = self.roots()
            x, y = root[a], root[b]
            apart = x != y
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(self.parent, np.maximum(x, y), np.minimum(x, y))


def _compare(x: np.ndarray, left: np.ndarray, right: np.ndarray, forest: Forest, radius: int = RADIUS) -> None:
    """Link all pairs of left and right within radius, in blocks of bounded size."""
    step = max(1, (1 << 20) // max(1, len(right)))
    for at in range(0, len(left), step):
        part = left[at : at + step]
        i, j = np.nonzero(np.bitwise_count(x[part][:, None] ^ x[right][None, :]) <= radius)
        forest.link(part[i], right[j])


def parts(n: int = PARTS) -> list[int]:
    """Masks of n parts of the bits; fingerprints within RADIUS bits are within RADIUS // n bits in one of them."""
    return [sum(1 << int(b) for b in cut) for cut in np.array_split(np.arange(64), n)]


def distances(x: np.ndarray, point: int | np.uint64, mask: int) -> np.ndarray:
    return np.bitwise_count((x ^ np.uint64(point)) & np.uint64(mask)).astype(np.int64)


def _radius(d: np.ndarray) -> int | None:
    """The median distance, or less so that some are beyond it; none if all are equal."""
    if d.min() == d.max():
        return None
    return min(int(np.median(d)), int(d.max()) - 1)


def vantage_links(x: np.ndarray, members: np.ndarray, visitors: np.ndarray, forest: Forest, mask: int = ALL, reach: int = RADIUS) -> int:
    """Link members with members and visitors within RADIUS, where they are within reach under mask; the nodes split."""
    stack, split = [(members, visitors, mask, reach)], 0
    while stack:
        m, v, mask, reach = stack.pop()
        if len(m) <= LEAF:
            _compare(x, m, np.concatenate([m, v]), forest)
            continue
        point = x[m[len(m) // 2]]
        d = distances(x[m], point, mask)
        cut = _radius(d)
        if cut is None:
            if mask == ALL:
                _compare(x, m, np.concatenate([m, v]), forest)
            else:
                stack.append((m, v, ALL, RADIUS))
            continue
        split += 1
        inner, dv = d <= cut, distances(x[v], point, mask)
        stack.append((m[inner], np.concatenate([m[~inner & (d <= cut + reach)], v[dv <= cut + reach]]), mask, reach))
        stack.append((m[~inner], v[dv > cut - reach], mask, reach))
    return split


@dataclass
class Node:
    """Of a planted tree: a vantage point, its radius and both sides, or the number of a leaf."""

    point: int = 0
    cut: int = 0
    inner: Node | None = None
    outer: Node | None = None
    leaf: int = 0


def plant(x: np.ndarray, mask: int, levels: int) -> tuple[Node, int]:
    """A tree of at most so many levels that halves the sample at each, and how many leaves it has."""
    leaves = 0

    def grow(x: np.ndarray, left: int) -> Node:
        nonlocal leaves
        best = None
        if left and len(x) > 1:
            for point in x[np.linspace(0, len(x) - 1, 8).astype(int)]:
                d = distances(x, point, mask)
                cut = _radius(d)
                if cut is not None:
                    inside, crossing = (d <= cut).mean(), ((d > cut) & (d <= cut + RADIUS // PARTS)).mean()
                    cost = max(inside, 1 - inside) + crossing
                    if best is None or cost < best[0]:
                        best = cost, int(point), cut, d <= cut
        if best is None:
            leaves += 1
            return Node(leaf=leaves - 1)
        return Node(best[1], best[2], grow(x[best[3]], left - 1), grow(x[~best[3]], left - 1))

    return grow(x, levels), leaves


def route(tree: Node, x: np.ndarray, mask: int, reach: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(leaf, members, visitors), as places in x."""
    stack = [(tree, np.arange(len(x)), np.arange(0))]
    while stack:
        node, m, v = stack.pop()
        if not len(m) and not len(v):
            continue
        if node.inner is None:
            yield node.leaf, m, v
            continue
        d, dv = distances(x[m], node.point, mask), distances(x[v], node.point, mask)
        inner = d <= node.cut
        stack.append((node.inner, m[inner], np.concatenate([m[~inner & (d <= node.cut + reach)], v[dv <= node.cut + reach]])))
        stack.append((node.outer, m[~inner], v[dv > node.cut - reach]))


def _shard_links(masks: dict[int, int], reach: int):
    """From rows (shard, home, fp) sorted by shard: an edge from each linked member to its set's smallest, a shard at a time."""

    def close(mask: int, rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(rows)
        home, fp = whole.column(1).to_numpy(), whole.column(2).to_numpy()
        x, forest = fp.view(np.uint64), Forest(len(fp))
        vantage_links(x, np.flatnonzero(home), np.flatnonzero(~home), forest, mask, reach)
        root = forest.roots()
        moved = np.flatnonzero(root != np.arange(len(fp)))
        for at in range(0, len(moved), 50_000):
            i = moved[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(fp[i]), pa.array(fp[root[i]])], ["u", "v"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            shard = batch.column(0).to_numpy()
            edges = [0, *(np.flatnonzero(shard[1:] != shard[:-1]) + 1).tolist(), len(shard)]
            for a, b in zip(edges, edges[1:], strict=False):
                if a == b:
                    continue
                if held and shard[a] != now:
                    yield from close(masks[now], held)
                    held = []
                now = int(shard[a])
                held.append(batch.slice(a, b - a))
        if held:
            yield from close(masks[now], held)

    return run


def links(nodes: DataFrame, shard: int = SHARD) -> DataFrame:
    """Edges (u, v) whose components are those of the distinct fingerprints ``fp`` within RADIUS bits."""
    n, reach = nodes.count(), RADIUS // PARTS
    levels = min(LEVELS, max(0, math.ceil(math.log2(max(1, n) / shard))))
    sample = np.array([r.fp for r in nodes.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()], np.int64).view(np.uint64) if levels else np.zeros(0, np.uint64)
    trees, first, mask_of = [], 0, {}
    for mask in parts():
        tree, leaves = plant(sample, mask, levels)
        trees.append((tree, mask, first))
        mask_of |= dict.fromkeys(range(first, first + leaves), mask)
        first += leaves

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy()
            for tree, mask, low in trees:
                for leaf, m, v in route(tree, fp.view(np.uint64), mask, reach):
                    home = np.concatenate([np.ones(len(m), bool), np.zeros(len(v), bool)])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(home), low + leaf, np.int32)), pa.array(home), pa.array(fp[np.concatenate([m, v])])], ["shard", "home", "fp"])

    dealt = nodes.select("fp").mapInArrow(deal, "shard int, home boolean, fp long")
    return dealt.repartitionById(first, F.col("shard")).sortWithinPartitions("shard").mapInArrow(_shard_links(mask_of, reach), "u long, v long")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, root: the smallest node of each component of edges (u, v), for every node that an edge has."""
    flat = lambda e: e.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now, before = materialize(flat(edges), "edges"), None
    for _ in range(rounds):
        sign = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if sign == before:
            break
        before = sign
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = flat(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        old, now = now, materialize(flat(small), "edges")
        discard(old)
    else:
        raise RuntimeError("components didn't settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _join(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From all edges (u, v), in one task: node, root as of components."""
    rows = [*batches]
    if not rows:
        return
    whole = pa.Table.from_batches(rows)
    u, v = whole.column(0).to_numpy(), whole.column(1).to_numpy()
    x, place = np.unique(np.concatenate([u, v]), return_inverse=True)
    forest = Forest(len(x))
    forest.link(place[: len(u)], place[len(u) :])
    root = x[forest.roots()]
    for at in range(0, len(x), 50_000):
        yield pa.RecordBatch.from_arrays([pa.array(x[at : at + 50_000]), pa.array(root[at : at + 50_000])], ["node", "root"])


def joined(edges: DataFrame, most: int | None = None) -> DataFrame:
    """What components gives; up to ``most`` edges (EDGES) without rounds, whose many small files cost more than their rows."""
    found = materialize(edges.where("u <> v").distinct(), "edges")
    if found.count() > (EDGES if most is None else most):
        return components(found)
    return found.coalesce(1).mapInArrow(_join, "node long, root long")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """doc_id, fingerprint (hex), component_id (the smallest doc_id reachable), for every row.

    With keep, also class_fp (a fingerprint that names the component even if its doc_ids are null) and those columns,
    as kept_0, kept_1 and so on.
    """
    found = materialize(fingerprints(docs, key, text, keep=keep), "fingerprints")
    nodes = materialize(found.groupBy("fp").agg(F.min("doc_id").alias("low")), "nodes")
    roots = joined(links(nodes.select("fp")))
    named = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    named = materialize(named, "components")
    least = named.groupBy("root").agg(F.min("low").alias("component_id"))
    classes = named.join(least, "root").select("fp", "component_id", F.col("root").alias("class_fp"))
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    extra = ["class_fp", *[f"kept_{i}" for i in range(len(keep))]] if keep else []
    return found.join(classes, "fp").select("doc_id", hexed.alias("fingerprint"), "component_id", *extra)
