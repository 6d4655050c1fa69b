"""Pairs of events of one key within a while of each other, in batch and across two streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.intervals import interval_join


def followed_by(first: DataFrame, then: DataFrame, *, key: str = "user_id", at: str = "ts", item: str = "event_id", within: str = "1 hour", late: str | None = None) -> DataFrame:
    """(key, first_id, first_at, then_id, then_at) of all events in ``then`` that follow one of ``first`` with the same key by
    no more than ``within``; at the very moment counts.

    As streams, both sides need ``late``, how far behind its newest event one may come: a side keeps an event as long as one
    of the other side may still meet it, and drops what is later than its watermark. Events without key or time meet none.
    """
    a = first.select(F.col(key), F.col(item).alias("first_id"), F.col(at).alias("first_at"))
    b = then.select(F.col(key), F.col(item).alias("then_id"), F.col(at).alias("then_at"))
    if not first.isStreaming and not then.isStreaming:  # a key with very many events is cut into buckets of time
        a = a.withColumn("_until", F.col("first_at") + F.expr(f"interval {within}"))
        b = b.withColumn("_then", F.col("then_at"))
        met = interval_join(a, b, on=[key], left_ends=("first_at", "_until"), right_ends=("then_at", "_then"), width=within)
        return met.select(key, "first_id", "first_at", "then_id", "then_at")
    a = a.withColumnRenamed(key, "_key")
    if late:
        a, b = a.withWatermark("first_at", late), b.withWatermark("then_at", late)
    near = (F.col("_key") == F.col(key)) & (F.col("then_at") >= F.col("first_at")) & (F.col("then_at") <= F.col("first_at") + F.expr(f"interval {within}"))
    return a.join(b, near).select(key, "first_id", "first_at", "then_id", "then_at")
