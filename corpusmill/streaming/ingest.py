"""Continuous ingestion: new files of documents are chunked and upserted batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.tokens import APPROXIMATE, TokenCounter
from ..operators.chunking import chunk_documents
from ..operators.store import VersionedStore


def stream_documents(spark: SparkSession, path: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def upsert_stream(docs: DataFrame, store: VersionedStore, checkpoint: str, embed: Callable[[DataFrame], DataFrame] | None = None, counter: TokenCounter = APPROXIMATE) -> StreamingQuery:
    """Each micro-batch of (doc_url, doc_title, section, body) becomes chunks in the store.

    A repeated batch changes nothing: the upsert is idempotent, and the checkpoint remembers the files that are done.
    """

    def write(batch: DataFrame, _: int) -> None:
        chunks = chunk_documents(batch, key=["doc_url", "doc_title", "section"], counter=counter)
        chunks = embed(chunks) if embed else chunks.withColumn("embedding", F.array().cast("array<float>"))
        store.upsert(chunks.withColumn("metadata", F.lit("{}")).withColumn("pos", F.col("chunk_index")))

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_windows(events: DataFrame, *, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Counts and sums of events by type and window of event time; late ones are dropped after the watermark."""
    w = events.withWatermark("ts", late) if events.isStreaming else events
    return w.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("total")).select(F.col("w.start").alias("day"), "event_type", "events", "total")
