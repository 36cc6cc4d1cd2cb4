"""Text collections and collections of several vector spaces, on top of the store."""

from __future__ import annotations

import json
from collections.abc import Sequence
from typing import Any

from pyspark.sql import functions as F

from .. import errors
from ..operators import fusion
from ..operators.search import knn
from .embed import EmbeddingFunction
from .postings import KeywordIndex
from .store import Client, Collection

DOCUMENT = "_document"
#: Folders of a text collection's keywords.
TEXT_BUCKETS = 16


class TextCollection:
    """Texts in, texts out: dense search by an embedding function and keyword search by BM25.

    Keyword statistics are those of the stored documents, so they outlive the session. Their inverted lists are stored
    beside the collection at the first keyword query, and follow what is added and deleted here.
    """

    def __init__(self, client: Client, name: str, embedding: EmbeddingFunction, dimensions: int | None = None, metric: str = "cosine", index_type: str = "flat", bm25: bool = True):
        dimensions = dimensions or getattr(embedding, "dimensions", None) or len(embedding(["a"])[0])
        self.embedding, self.bm25 = embedding, bm25
        self.collection: Collection = client.get_or_create_collection(name, dimensions, metric, index_type)

    name = property(lambda self: self.collection.name)
    count = property(lambda self: self.collection.count)

    def add(self, ids: Sequence[int], documents: Sequence[str], payloads: Sequence[dict | None] | None = None) -> None:
        payloads = payloads if payloads is not None else [None] * len(ids)
        if not len(ids) == len(documents) == len(payloads):
            raise errors.InvalidConfig("ids, documents and payloads differ in length")
        if ids:
            vectors, current = self.embedding(list(documents)), self._current()
            self.collection.upsert_batch([(i, v, {**(p or {}), DOCUMENT: d}) for i, v, d, p in zip(ids, vectors, documents, payloads, strict=True)])
            if current:
                last = dict(zip(ids, documents, strict=True))  # of an id that is given twice
                current.upsert(self.collection.spark.createDataFrame(list(last.items()), "id long, text string"))
                current.mark(self.collection._manifest()["version"])

    def delete(self, ids: Sequence[int]) -> None:
        current = self._current()
        if self.collection.delete_batch(ids) and current:
            current.remove(self.collection.spark.createDataFrame([(int(i),) for i in ids], "id long"))
            current.mark(self.collection._manifest()["version"])

    def _current(self) -> KeywordIndex | None:
        """The stored lists, if they are those of the documents as they are now."""
        path = f"{self.collection.path}/keywords"
        if not self.collection.files.versions(f"{path}/about"):
            return None
        found = KeywordIndex(self.collection.spark, path)
        return found if found.about["of"] == self.collection._manifest()["version"] else None

    def _keywords(self) -> KeywordIndex:
        found = self._current()
        if found is None:
            path = f"{self.collection.path}/keywords"
            self.collection.files.delete(path)
            found = KeywordIndex.build(self._texts(), path, buckets=TEXT_BUCKETS)
            found.mark(self.collection._manifest()["version"])
        return found

    def _texts(self):
        payload = F.try_parse_json("payload")
        return self.collection.rows().select("id", "vec", "payload", F.try_variant_get(payload, f"$.{DOCUMENT}", "string").alias("text"))

    def query(self, text: str, k: int = 10, mode: str = "hybrid", dense_weight: float = fusion.DENSE_WEIGHT, sparse_weight: float = fusion.SPARSE_WEIGHT, filter: dict | None = None, filter_mode: str = "exact") -> list[dict]:
        """mode: hybrid, semantic or keyword. Keyword ranks may end with documents that lack every keyword.

        filter_mode: exact, or overscan (which may return fewer than k).
        """
        if mode not in ("hybrid", "semantic", "keyword"):
            raise errors.InvalidConfig(f"unknown mode {mode!r}")
        if mode == "keyword" and not self.bm25:
            raise errors.InvalidConfig("keyword search is off")
        words: dict = {}
        if mode != "semantic" and self.bm25:
            postings, words = self._keywords().postings(text)
        if mode == "keyword" and not words:
            return []
        query = self.embedding([text])[0]
        if not words:
            return [self._result(r) for r in self.collection.search(query, k, filter, filter_mode)]
        weights = (0.0, 1.0) if mode == "keyword" else (dense_weight, sparse_weight)
        where = self.collection._where(filter)
        texts = self.collection.rows().select("id", "vec", "payload")
        found = fusion.hybrid(texts, postings, query, words, k, self.collection.metric, *weights, where, mode=filter_mode)
        rows = found.join(texts.select("id", "payload"), "id").orderBy(F.desc("score"), "id").collect()
        return [self._result({"id": r.id, "score": r.score, "dense_distance": r.dense_distance, "sparse_score": r.sparse_score, "payload": json.loads(r.payload)}) for r in rows]

    @staticmethod
    def _result(found: dict) -> dict:
        payload = dict(found.pop("payload", None) or {})
        document = payload.pop(DOCUMENT, None)
        return found | {"document": document} | ({"payload": payload} if payload else {})


class MultiVectorCollection:
    """Several vector spaces that share ids; payloads have a collection of their own, so none is lost."""

    def __init__(self, client: Client, name: str, vector_spaces: dict[str, int | dict], metric: str = "cosine", index_type: str = "flat"):
        if not vector_spaces:
            raise errors.InvalidConfig("at least one vector space is needed")
        self.name, self.spaces = name, {}
        for space, spec in vector_spaces.items():
            spec = {"dimensions": spec} if isinstance(spec, int) else spec
            self.spaces[space] = client.get_or_create_collection(f"{name}__{space}", spec["dimensions"], spec.get("metric", metric), spec.get("index_type", index_type))
        self.documents = client.get_or_create_collection(f"{name}__documents__", 1, "l2", "flat")

    @property
    def vector_spaces(self) -> list[str]:
        return sorted(self.spaces)

    @property
    def count(self) -> int:
        return max(c.count for c in self.spaces.values())

    def _space(self, name: str) -> Collection:
        if name not in self.spaces:
            raise errors.CollectionNotFound(name)
        return self.spaces[name]

    def upsert(self, id: int, vectors: dict[str, Sequence[float]], payload: Any = None) -> None:
        self.upsert_batch([(id, vectors, payload)])

    def upsert_batch(self, entries: Sequence[tuple]) -> None:
        """(id, {space: vector}) or (id, {space: vector}, payload); spaces that aren't given stay as they are."""
        by: dict[str, list] = {}
        for e in entries:
            for space, v in e[1].items():
                self._space(space)
                by.setdefault(space, []).append((e[0], v))
        for space, rows in by.items():
            self.spaces[space].upsert_batch(rows)
        self.documents.upsert_batch([(e[0], [0.0], e[2] if len(e) > 2 else None) for e in entries])

    def search(self, space: str, query: Sequence[float], k: int, filter: dict | None = None) -> list[dict]:
        if filter is None:
            return self._space(space).search(query, k)
        allowed = self.documents.rows().where(self.documents._where(filter)).select("id")
        c = self._space(space)
        return [{"id": r.id, "distance": r.distance} for r in knn(c.rows().join(allowed, "id", "left_semi"), query, k, c.metric).collect()]

    def search_multi(self, queries: dict[str, Sequence[float]], k: int, weights: dict[str, float] | None = None, filter: dict | None = None) -> list[dict]:
        many = fusion.space_overscan(k)
        candidates = {s: self._space(s).search_frame(q, many).select("id", "distance") for s, q in queries.items()}
        if filter is not None:
            allowed = self.documents.rows().where(self.documents._where(filter)).select("id")
            candidates = {s: c.join(allowed, "id", "left_semi") for s, c in candidates.items()}
        found = fusion.fuse_spaces(candidates, k, weights).join(self.documents.rows().select("id", "payload"), "id", "left")
        rows = found.orderBy(F.desc("score"), "id").collect()
        return [{"id": r.id, "score": r.score, "distances": dict(r.distances)} | ({} if r.payload is None else {"payload": json.loads(r.payload)}) for r in rows]

    def delete(self, id: int) -> None:
        self.delete_batch([id])

    def delete_batch(self, ids: Sequence[int]) -> None:
        for c in (*self.spaces.values(), self.documents):
            c.delete_batch(ids)


__all__ = ["DOCUMENT", "MultiVectorCollection", "TextCollection"]
