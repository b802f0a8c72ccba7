"""Structured Streaming into a document store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from docmill.sources.store import DocumentStore


def ingest(stream: DataFrame, store: DocumentStore, checkpoint: str, commit: bool = True, **trigger) -> StreamingQuery:
    """Adds each micro-batch of a stream of ``fields`` maps as one batch of the store.

    A micro-batch that runs again after a failure finds its batch in the store and adds nothing, so documents arrive once.
    """

    def add(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            store.add(batch, f"stream-{number:012d}")
            if commit:
                store.commit()

    return stream.select("fields").writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
