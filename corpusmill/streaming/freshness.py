"""What is new about chunks that are seen again and again: changed contents once, and chunks that are seen no more."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

_OUT = "key string, at timestamp, content_hash string, event string"


def _seen(rows: DataFrame, key: list[str], content: str, at: str) -> DataFrame:
    """(key, at, content_hash): one text stands for all key columns; a null content has a hash of its own."""
    name = F.to_json(F.struct(*key), {"ignoreNullFields": "false"})
    return rows.where(F.col(at).isNotNull()).select(name.alias("key"), F.col(at).alias("at"), F.coalesce(F.sha2(F.col(content).cast("string"), 256), F.lit("-")).alias("content_hash"))


def content_events(rows: DataFrame, *, key: list[str], content: str = "content", at: str = "seen_at", expire: str = "30 days") -> DataFrame:
    """(key, at, content_hash, event) of a table of sightings.

    ``changed``: the content differs from that of the sighting before, or there was none within ``expire``. ``expired``: the
    chunk isn't seen for ``expire`` after a sighting, while the table goes on beyond that moment, which is its time. Of
    several sightings of one chunk at one time, the one with the greatest hash counts. Sightings without a time go.
    """
    seen = _seen(rows, key, content, at).groupBy("key", "at").agg(F.max("content_hash").alias("content_hash"))
    order, gap = Window.partitionBy("key").orderBy("at"), F.expr(f"interval {expire}")
    seen = seen.withColumns({"before": F.lag("content_hash").over(order), "last": F.lag("at").over(order), "next": F.lead("at").over(order)})
    end = seen.agg(F.max("at").alias("end"))
    seen = seen.crossJoin(F.broadcast(end))  # one row
    changed = seen.where(F.col("before").isNull() | (F.col("before") != F.col("content_hash")) | (F.col("last") + gap < F.col("at")))
    expired = seen.where(F.least(F.coalesce("next", "end"), F.col("end")) > F.col("at") + gap)
    return changed.select("key", "at", "content_hash", F.lit("changed").alias("event")).union(expired.select("key", F.col("at") + gap, "content_hash", F.lit("expired")))


class _Freshness(StatefulProcessor):
    """Keeps the hash and time of a chunk's last sighting, and a timer for the moment at which it expires."""

    def __init__(self, expire_ms: int):
        self.expire_ms = expire_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "content_hash string, at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seen = pd.concat(list(rows)).groupby("at")["content_hash"].max().sort_index()
        out = []
        for at, content in seen.items():
            now = int(at.timestamp() * 1000)
            known, last = self.last.get() if self.last.exists() else (None, None)
            if last is not None and now < last:
                continue  # comes late: a later sighting was told already
            if last is not None and now - last > self.expire_ms:
                out.append((key[0], pd.Timestamp(last + self.expire_ms, unit="ms"), known, "expired"))
                known = None
            if known != content:
                out.append((key[0], at, content, "changed"))
            if last is not None and now != last:
                self.handle.deleteTimer(last + self.expire_ms)
            self.last.update((content, now))
            self.handle.registerTimer(now + self.expire_ms)
        yield pd.DataFrame(out, columns=["key", "at", "content_hash", "event"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        content, last = self.last.get()
        self.last.clear()
        yield pd.DataFrame([(key[0], pd.Timestamp(last + self.expire_ms, unit="ms"), content, "expired")], columns=["key", "at", "content_hash", "event"])

    def close(self) -> None:
        pass


def stream_content_events(rows: DataFrame, *, key: list[str], content: str = "content", at: str = "seen_at", expire_seconds: int = 30 * 86_400, late: str = "1 day") -> DataFrame:
    """``content_events`` of a stream: a changed content is given out once, with its batch; a chunk expires once the watermark,
    ``late`` behind the newest sighting, has passed its moment, and its state goes with it. Later rows than that are dropped.
    Times are kept to the millisecond. Needs the RocksDB state store."""
    seen = _seen(rows, key, content, at).withWatermark("at", late)
    return seen.groupBy("key").transformWithStateInPandas(_Freshness(expire_seconds * 1000), _OUT, "Append", "EventTime")
