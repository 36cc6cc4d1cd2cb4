"""vecframe: vector, keyword and hybrid search as Spark plans."""

from .operators.indexes import BinaryFlatIndex, FlatIndex, Fp16FlatIndex, HnswIndex, IvfIndex, IvfPqIndex, MmapFlatIndex, QuantizedFlatIndex, SparseIndex
from .operators.keyword import BM25
from .sources.collections import MultiVectorCollection, TextCollection
from .sources.embed import EmbeddingFunction, HttpEmbedding, OpenAIEmbedding, SentenceTransformerEmbedding
from .sources.postings import KeywordIndex
from .sources.server import create_server
from .sources.store import Client, Collection

__all__ = [
    "BM25", "BinaryFlatIndex", "Client", "Collection", "EmbeddingFunction", "FlatIndex", "Fp16FlatIndex", "HnswIndex", "HttpEmbedding", "IvfIndex", "IvfPqIndex", "MmapFlatIndex", "KeywordIndex", "MultiVectorCollection", "OpenAIEmbedding",
    "QuantizedFlatIndex", "SentenceTransformerEmbedding", "SparseIndex", "TextCollection", "create_server",
]
