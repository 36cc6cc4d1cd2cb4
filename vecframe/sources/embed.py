"""Text embedding functions, and their use on columns."""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Iterable, Iterator
from typing import Protocol, runtime_checkable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, FloatType, StructField, StructType


@runtime_checkable
class EmbeddingFunction(Protocol):
    """Anything that turns texts into vectors; ``dimensions`` may be None if it isn't known."""

    def __call__(self, texts: list[str]) -> list[list[float]]: ...


class SentenceTransformerEmbedding:
    """By a local model of the sentence_transformers library, which is imported on first use."""

    def __init__(self, model_name: str = "all-MiniLM-L6-v2", **options):
        self.model_name, self.options, self._model = model_name, options, None

    def _load(self):
        if self._model is None:
            try:
                from sentence_transformers import SentenceTransformer
            except ImportError as e:
                raise ImportError("sentence_transformers is needed for this embedding") from e
            self._model = SentenceTransformer(self.model_name, **self.options)
        return self._model

    def __call__(self, texts: list[str]) -> list[list[float]]:
        return [list(map(float, v)) for v in self._load().encode(list(texts))]

    @property
    def dimensions(self) -> int:
        return self._load().get_sentence_embedding_dimension()


class HttpEmbedding:
    """By an HTTP service that answers {"input": texts, "model": ...} with {"data": [{"index", "embedding"}]}."""

    def __init__(self, url: str, model: str, api_key: str | None = None, dimensions: int | None = None, timeout: float = 60):
        self.url, self.model, self.api_key, self.dimensions, self.timeout = url, model, api_key, dimensions, timeout

    def __call__(self, texts: list[str]) -> list[list[float]]:
        body = {"input": list(texts), "model": self.model} | ({"dimensions": self.dimensions} if self.dimensions else {})
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.api_key}"} if self.api_key else {})
        with urllib.request.urlopen(urllib.request.Request(self.url, json.dumps(body).encode(), headers), timeout=self.timeout) as answer:
            return [x["embedding"] for x in sorted(json.load(answer)["data"], key=lambda x: x["index"])]


class OpenAIEmbedding(HttpEmbedding):
    """By the OpenAI service (or a compatible one at url); dimensions are known for its own models."""

    #: The service's address, and the dimensions of its models.
    URL = "https://api.openai.com/v1/embeddings"
    KNOWN = {"text-embedding-3-small": 1536, "text-embedding-3-large": 3072, "text-embedding-ada-002": 1536}

    def __init__(self, model: str = "text-embedding-3-small", api_key: str | None = None, dimensions: int | None = None, url: str = URL, timeout: float = 60):
        super().__init__(url, model, api_key, dimensions, timeout)
        self.asked, self.dimensions = dimensions, dimensions or self.KNOWN.get(model)

    def __call__(self, texts: list[str]) -> list[list[float]]:
        found = HttpEmbedding(self.url, self.model, self.api_key, self.asked, self.timeout)
        return found(texts)


def embed_column(df: DataFrame, embed: EmbeddingFunction, text: str = "text", out: str = "vec", batch: int = 256) -> DataFrame:
    """df with the embeddings of its texts (null: empty), computed on the executors in batches."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for at in range(0, part.num_rows, batch):
                rows = part.slice(at, batch)
                found = embed([x or "" for x in rows.column(rows.schema.get_field_index(text)).to_pylist()])
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array([list(map(float, v)) for v in found], pa.list_(pa.float32()))], [*rows.schema.names, out])

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField(out, ArrayType(FloatType()))]))
