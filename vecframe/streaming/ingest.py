"""Streams into collections, and searches over streams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..functions import metrics
from ..sources.store import Collection


def upsert_stream(stream: DataFrame, collection: Collection, checkpoint: str, name: str = "stream", available_now: bool = True) -> StreamingQuery:
    """Append every micro-batch (id, vec, and payload, sparse, n if there) once: a batch that is repeated is recognised."""

    def write(df: DataFrame, batch: int) -> None:
        collection.upsert_frame(df, batch=f"{name}:{batch}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def delete_stream(stream: DataFrame, collection: Collection, checkpoint: str, name: str = "deletes", available_now: bool = True) -> StreamingQuery:
    def write(df: DataFrame, batch: int) -> None:
        collection.delete_frame(df, batch=f"{name}:{batch}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def alerts(stream: DataFrame, query: Sequence[float], within: float, metric: str = "l2", id: str = "id", vec: str = "vec") -> DataFrame:
    """A stream of id, distance of the arriving rows that are within a distance of a fixed query."""
    d = metrics.true_distance(metric, metrics.query_distance(metric, stream[vec], query))
    return stream.select(stream[id].alias("id"), d.alias("distance")).where(d <= within)
