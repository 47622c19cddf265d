"""Streams of documents into a store.

Each micro-batch is an ordinary ingest, which leaves out stored and repeated
chunks; a batch that is delivered again adds nothing, so at-least-once delivery
is safe.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators import chunker
from ..sources.store import Store


def ingest_stream(documents: DataFrame, store: Store, collection: str, checkpoint: str, options: chunker.Options = chunker.Options(), available_now: bool = True) -> StreamingQuery:
    """documents: a stream of (doc_pos, text, kind, metadata)."""
    writer = documents.writeStream.foreachBatch(lambda batch, _: store.ingest(batch, collection, options) and None)
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
