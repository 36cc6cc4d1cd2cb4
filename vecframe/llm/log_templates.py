"""Operator 5: line dedup by a log-template tree.

A line's tokens are its runs of non-space characters, those with a digit masked. The tree is of fixed depth: token
count, then the first ``DEPTH`` tokens, then one of ``TWIGS`` hashes of the line. At a twig, lines (most frequent first,
then by hash) join the template that equals them in the largest share of positions if that is at least ``SIMILAR``,
and positions that differ become variable; else they start a template. The templates of a leaf's twigs (in as many
documents as their lines, then by hash) are joined by the same rule, variable positions being equal to each other. So
a template of any number of lines is parsed by many tasks, and the rule is the same at every size. A template that occurs in ``min_docs`` documents (two) recurs: its lines are
dropped from every document but the first (least doc_id, nulls last), so that no content vanishes altogether.

Lines are counted by distinct masked line, as hashes, before any text moves; only leaves with several lines are
parsed, from one copy of each line. Tokens move as 32-bit hashes. Which lines go is decided by joins on hashes of lines, and only documents' own lists of them
are brought to their texts.

Blank lines stay, wherever they are; null texts stay null and have no lines; a document may become empty. Rows equal
in doc_id and text count as one document. An empty table gives no rows; all other columns are kept.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, fresh, materialize, plain_names, row_keys, slices

DEPTH, TWIGS, SIMILAR, MIN_DOCS = 3, 16, 0.7, 2
#: Templates of a leaf that are compared one by one; beyond, those that share a block of tokens.
SCANNED = 100
DIGIT = re.compile(r"\d")
WILD = 0


def token_hash(token: str) -> int:
    return 1 if DIGIT.search(token) else max(2, zlib.crc32(token.encode()))


def masked(line: str) -> str:
    found = line.split()
    return " ".join(["<*>" if DIGIT.search(x) else x for x in found] if DIGIT.search(line) else found)


def line_hash(line: str) -> int:
    return xxhash.xxh64_intdigest(masked(line), 5) - (1 << 63)


def leaf_hash(norm: list[str]) -> int:
    return xxhash.xxh64_intdigest(" ".join(norm[:DEPTH]), len(norm)) - (1 << 63)


def _lines(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (ka, kb, doc_id, text): a row for each distinct masked line of a document."""
    digest = xxhash.xxh64_intdigest
    for batch in slices(batches):
        at, leaf, line = [], [], []
        for i, text in enumerate(batch.column(3).to_pylist()):
            if not text:
                continue
            seen, digits = set(), DIGIT.search(text)
            for raw in text.split("\n"):
                norm = raw.split()
                if not norm:
                    continue
                if digits and DIGIT.search(raw):
                    norm = ["<*>" if DIGIT.search(x) else x for x in norm]
                h = digest(" ".join(norm), 5) - (1 << 63)
                if h not in seen:
                    seen.add(h)
                    at.append(i)
                    line.append(h)
                    leaf.append(leaf_hash(norm))
        keys = [batch.column(j).take(pa.array(at, pa.int64())) for j in range(3)]
        yield pa.RecordBatch.from_arrays([*keys, pa.array(leaf, pa.int64()), pa.array(line, pa.int64())], ["ka", "kb", "doc_id", "leaf", "line"])


def _tokens(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (text, wanted): leaf, line, docs and token hashes of the lines wanted."""
    for batch in slices(batches):
        rows = []
        for text, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            left = {w["line"]: w for w in wanted}
            for raw in (text or "").split("\n"):
                w = left.pop(line_hash(raw), None) if left and raw.strip() else None
                if w:
                    x = np.fromiter(map(token_hash, raw.split()), np.uint32).astype("<u4").tobytes()
                    rows.append((w["leaf"], w["line"], w["docs"], x))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["leaf", "line", "docs", "tokens"])


class Leaf:
    """The templates of one leaf or twig, from lines (or templates) in their order of arrival.

    A line that joins a template differs from it in at most ``spare`` positions, so it agrees with it on one of
    spare + 1 blocks of positions. Beyond ``SCANNED`` templates only those that share a block are compared, which are
    all that can be joined; blocks are entered again when one of their positions becomes variable.
    """

    def __init__(self, size: int, similar: float = SIMILAR):
        self.size, self.similar = size, similar
        spare = size - next(m for m in range(size + 1) if m / size >= similar)
        low = DEPTH if size - DEPTH > spare else 0
        edges = [4 * (low + (size - low) * i // (spare + 1)) for i in range(spare + 2)]
        self.blocks = list(zip(edges, edges[1:], strict=False))
        self.sharing: list[dict[bytes, list[int]]] | None = None
        self.rows, self.names = np.empty((4, size), "<u4"), []

    def _enter(self, i: int, x: bytes) -> None:
        for (a, b), found in zip(self.blocks, self.sharing, strict=True):
            at = found.setdefault(x[a:b], [])
            if i not in at[-1:]:
                at.append(i)

    def _best(self, row: np.ndarray, x: bytes) -> tuple[int, float]:
        """The template that equals the row in the largest share of positions (the first of equals), and the share."""
        n = len(self.names)
        if n <= SCANNED:
            share = (self.rows[:n] == row).mean(axis=1)
            best = int(share.argmax())
            return best, share[best]
        if self.sharing is None:
            self.sharing = [{} for _ in self.blocks]
            for i in range(n):
                self._enter(i, self.rows[i].tobytes())
        near = {i for (a, b), found in zip(self.blocks, self.sharing, strict=True) for i in found.get(x[a:b], ())}
        if not near:
            return -1, -1.0
        at = np.sort(np.fromiter(near, np.int64, len(near)))
        share = (self.rows[at] == row).mean(axis=1)
        best = int(share.argmax())
        return int(at[best]), share[best]

    def add(self, line: int, x: bytes) -> int:
        """The number of the line's template; names has the hash of its first line."""
        row = np.frombuffer(x, "<u4")
        if self.names:
            best, share = self._best(row, x)
            if share >= self.similar:
                found = self.rows[best]
                changed = found != row
                if (found[changed] != WILD).any():
                    found[changed] = WILD
                    if self.sharing is not None:
                        self._enter(best, found.tobytes())
                return best
        i = len(self.names)
        if i == len(self.rows):
            self.rows = np.concatenate([self.rows, np.empty_like(self.rows)])
        self.rows[i] = row
        self.names.append(line)
        if self.sharing is not None:
            self._enter(i, x)
        return i


def parse_leaf(lines: list[int], tokens: list[bytes], similar: float = SIMILAR) -> list[int]:
    """The template (the hash of its first line) of each line of one leaf, lines in their order of arrival."""
    leaf = Leaf(len(tokens[0]) // 4, similar)
    found = [leaf.add(line, x) for line, x in zip(lines, tokens, strict=True)]
    return [leaf.names[i] for i in found]


def _parsed(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """From (leaf, line, docs, tokens), sorted by leaf and arrival: the leaf, its templates, and of each line its hash, template and docs.

    Of a leaf, its templates and three numbers a line are held.
    """
    name, leaf = None, None
    lines, found, docs = array("q"), array("q"), array("q")
    for batch in batches:
        for at, line, n, x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if leaf is None or name != at:
                if leaf is not None:
                    yield name, leaf, np.array(lines), np.array(found), np.array(docs)
                name, leaf = at, Leaf(len(x) // 4)
                lines, found, docs = array("q"), array("q"), array("q")
            found.append(leaf.add(line, x))
            lines.append(line)
            docs.append(n)
    if leaf is not None:
        yield name, leaf, np.array(lines), np.array(found), np.array(docs)


def _parse_twigs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (leaf, twig, line, docs, tokens) by twig: of each line its template there, and where that began, tokens and documents."""
    plain = (pa.RecordBatch.from_arrays([_pair(b.column(0), b.column(1)), *b.columns[2:]], ["twig", "line", "docs", "tokens"]) for b in batches)
    for (leaf, _), found, lines, of, docs in _parsed(plain):
        names, total = np.array(found.names), np.bincount(of, weights=docs).astype(np.int64)
        first = names[of] == lines
        tokens = [found.rows[i].tobytes() if f else None for i, f in zip(of.tolist(), first.tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(lines), leaf)), pa.array(lines), pa.array(names[of]), pa.array(total[of]), pa.array(tokens, pa.binary())], ["leaf", "line", "local", "docs", "tokens"])


def _pair(leaf: pa.Array, twig: pa.Array) -> pa.Array:
    return pa.array(list(zip(leaf.to_pylist(), twig.to_pylist(), strict=True)), pa.list_(pa.int64()))


def _parse_leaves(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (leaf, local, docs, tokens) by leaf: the leaf's template of each local one, where it may recur."""
    for _, found, local, of, docs in _parsed(batches):
        names, total = np.array(found.names), np.bincount(of, weights=docs)
        kept = total[of] >= 2
        if kept.any():
            yield pa.RecordBatch.from_arrays([pa.array(local[kept]), pa.array(names[of[kept]])], ["local", "template"])


LINES = "ka long, kb long, doc_id long, leaf long, line long"


def line_rows(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """ka, kb, doc_id, leaf, line for the distinct masked lines of each document."""
    return docs.select(*row_keys(key, text), column(key).cast("long").alias("doc_id"), column(text).alias("text")).mapInArrow(_lines, LINES)


def templates(docs: DataFrame, lines: DataFrame, key: str = "doc_id", text: str = "text", min_docs: int = MIN_DOCS) -> DataFrame:
    """line, template: hashes of masked lines and of the templates that they belong to, where those may recur.

    A line alone in its leaf is its own template. The others' tokens are read from one document each.
    """
    distinct = lines.groupBy("leaf", "line").agg(F.count("*").alias("docs"), F.min(F.struct("ka", "kb")).alias("place"))
    distinct = materialize(distinct, "distinct-lines")
    leaves = distinct.groupBy("leaf").agg(F.count("*").alias("n"), F.sum("docs").alias("d")).where((F.col("n") > 1) & (F.col("d") >= min_docs))
    leaves = materialize(leaves.select("leaf"), "mixed-leaves")
    alone = distinct.where(F.col("docs") >= min_docs).join(leaves, "leaf", "left_anti").select("line", F.col("line").alias("template"))
    wanted = distinct.join(leaves, "leaf").groupBy("place").agg(F.collect_list(F.struct("leaf", "line", "docs")).alias("wanted"))
    texts = docs.select(*row_keys(key, text), column(text).alias("text")).join(wanted.select("place.*", "wanted"), ["ka", "kb"])
    dealt = texts.select("text", "wanted").mapInArrow(_tokens, "leaf long, line long, docs long, tokens binary")
    dealt = dealt.select("leaf", F.pmod("line", F.lit(TWIGS)).alias("twig"), "line", "docs", "tokens").repartition("leaf", "twig").sortWithinPartitions("leaf", "twig", F.desc("docs"), "line")
    twigs = materialize(dealt.mapInArrow(_parse_twigs, "leaf long, line long, local long, docs long, tokens binary"), "twigs")
    locals_ = twigs.where("tokens is not null").select("leaf", "local", "docs", "tokens").repartition("leaf").sortWithinPartitions("leaf", F.desc("docs"), "local")
    found = materialize(locals_.mapInArrow(_parse_leaves, "local long, template long"), "leaf-templates")
    return twigs.select("line", "local").join(found, "local").select("line", "template").unionByName(alone)


def _drop(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (text, gone, ...): the text without the lines that are gone, and counts."""
    for batch in slices(batches):
        texts, n_lines, n_dropped = [], [], []
        for text, gone in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            lines = text.split("\n") if text is not None else []
            if gone:
                gone = set(gone)
                kept = [x for x in lines if not x.strip() or line_hash(x) not in gone]
            else:
                kept = lines
            texts.append(None if text is None else "\n".join(kept))
            n_lines.append(len(lines))
            n_dropped.append(len(lines) - len(kept))
        yield pa.RecordBatch.from_arrays(
            [pa.array(texts, pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), *batch.columns[2:]],
            ["text", "n_lines", "n_dropped", *batch.schema.names[2:]],
        )


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_docs: int = MIN_DOCS) -> DataFrame:
    """The columns of docs, with the lines of recurring templates dropped from text; then how many lines there were and went.

    These two are __n_lines and __n_dropped, with more underscores ahead if docs has such names.
    """
    lines = materialize(line_rows(docs, key, text), "lines")
    named = materialize(templates(docs, lines, key, text, min_docs), "templates")
    uses = materialize(lines.select("ka", "kb", "doc_id", "line").join(named, "line"), "template-uses")
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), "ka", "kb")
    each = uses.groupBy("template", "ka", "kb").agg(F.min(order).alias("o"))
    recurring = each.groupBy("template").agg(F.count("*").alias("n"), F.min("o").alias("first")).where(F.col("n") >= min_docs)
    # Written, so that the join reads rows dealt for it alone: a hot template's rows can then be split over tasks.
    recurring = materialize(recurring.select("template", F.col("first.ka").alias("fa"), F.col("first.kb").alias("fb")), "recurring-templates")
    gone = uses.join(recurring, "template").where("ka <> fa or kb <> fb").groupBy("ka", "kb").agg(F.collect_set("line").alias("gone"))
    gone = materialize(gone, "dropped-lines")
    plain = plain_names(docs)
    k, t = (f"c{docs.columns.index(c)}" for c in (key, text))
    other = [c for c in plain.columns if c != t]
    whole = plain.select(*row_keys(k, t), F.struct(*plain.columns).alias("r")).join(gone, ["ka", "kb"], "left")
    whole = whole.select(F.col(f"r.{t}").alias("text"), "gone", *[f"r.{c}" for c in other])
    kinds = "".join(f", {c} {plain.schema[c].dataType.simpleString()}" for c in other)
    out = whole.mapInArrow(_drop, "text string, n_lines long, n_dropped long" + kinds)
    return out.select(*["text" if c == t else c for c in plain.columns], "n_lines", "n_dropped").toDF(*docs.columns, *fresh(docs, "__n_lines", "__n_dropped"))


def digest(out: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of what dedup_lines returns."""
    n_lines, n_dropped = (column(c) for c in out.columns[-2:])
    return out.select(column(key).alias("doc_id"), n_lines.alias("n_lines"), n_dropped.alias("n_dropped"), F.sha2(F.coalesce(column(text), F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def brute_force(docs: list[tuple[int | None, str | None]], min_docs: int = MIN_DOCS) -> list[str | None]:
    """The same result in plain Python, for tests."""
    lines: dict[int, tuple[str, set]] = {}
    for d in docs:
        for raw in (d[1] or "").split("\n"):
            if masked(raw):
                lines.setdefault(line_hash(raw), (masked(raw), set()))[1].add(d)
    leaves: dict[tuple, list[int]] = {}
    for h, (norm, _) in lines.items():
        t = norm.split()
        leaves.setdefault((len(t), *t[:DEPTH]), []).append(h)

    def parse(rows: list[tuple[int, int, list]]) -> tuple[dict[int, int], dict[int, list]]:
        """Of (documents, hash, tokens) each one's template, and the templates' tokens."""
        of, names = {}, {}
        for _, h, t in sorted(rows, key=lambda r: (-r[0], r[1])):
            share = {n: sum(a == b for a, b in zip(x, t, strict=True)) / len(t) for n, x in names.items()}
            best = max(share, key=share.get, default=None)
            if best is not None and share[best] >= SIMILAR:
                names[best] = [a if a == b else None for a, b in zip(names[best], t, strict=True)]
            else:
                names[best := h] = t
            of[h] = best
        return of, names

    of: dict[int, int] = {}
    for found in leaves.values():
        local, rows = {}, []
        for twig in range(TWIGS):
            own = [(len(lines[h][1]), h, lines[h][0].split()) for h in found if h % TWIGS == twig]
            one, names = parse(own)
            local |= one
            rows += [(sum(n for n, h, _ in own if one[h] == name), name, t) for name, t in names.items()]
        last, _ = parse(rows)
        of |= {h: last[name] for h, name in local.items()}
    users: dict[int, set] = {}
    for h, name in of.items():
        users.setdefault(name, set()).update(lines[h][1])
    order = lambda d: (d[0] is None, d[0] or 0)
    keeper = {n: min(u, key=order) for n, u in users.items() if len(u) >= min_docs}
    out = []
    for d in docs:
        kept = [x for x in (d[1] or "").split("\n") if not x.strip() or keeper.get(of[line_hash(x)], d) == d]
        out.append(None if d[1] is None else "\n".join(kept))
    return out


def sha(text: str | None) -> str:
    return hashlib.sha256((text or "").encode()).hexdigest()
