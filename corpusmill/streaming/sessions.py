"""Sessions of events: windows that last until a key has been silent for a while, in batch and in a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GAP = "30 minutes"


def user_sessions(events: DataFrame, *, key: str = "user_id", at: str = "ts", gap: str = GAP, late: str | None = None, aggregates: dict[str, Column] | None = None) -> DataFrame:
    """(key, started, ended, events, ...): runs of a key's events of which each is less than ``gap`` behind the one before.

    ``ended`` is the last event's time and the gap. In a stream, ``late`` is how far behind the newest event one may come and
    still count; a session is given out, once, when nothing can join it any more, and later events are dropped. In a batch
    all events count. Events without a time belong to no session; those without a key are one key's; repeated events
    count as often as they come. Sessions are merged within a task's rows before they are shuffled by key where
    ``spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition`` says so.
    """
    rows = events.withWatermark(at, late) if late else events
    more = [c.alias(n) for n, c in (aggregates or {}).items()]
    out = rows.groupBy(F.col(key), F.session_window(at, gap).alias("_w")).agg(F.count(F.lit(1)).alias("events"), *more)
    return out.select(key, F.col("_w.start").alias("started"), F.col("_w.end").alias("ended"), "events", *(aggregates or {}))
