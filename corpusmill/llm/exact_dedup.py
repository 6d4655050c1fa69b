"""Exact duplicates: binary fuse filters of an immutable snapshot screen the digests of a batch."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .binary_fuse import BinaryFuse8
from .common import read_table, stage

#: Digests in one filter, about 1.4 bytes each: small shards spread over many tasks, and none grows with the table.
KEYS_PER_SHARD = 2_048

#: Bits of the filter of suspects' digests that every task gets, whatever their number; 1 MB.
SUSPECT_BITS = 1 << 23

_FILTER = "shard long, seed int, segment int, segments int, slots binary"


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _digests(rows: DataFrame, shards: int) -> DataFrame:
    """Distinct digests with their shard and the 64-bit key that the filters hold."""
    return rows.select("_sha").distinct().select("_sha", F.pmod(F.xxhash64("_sha"), F.lit(shards)).alias("shard"), F.xxhash64("_sha", F.lit(1)).alias("key"))


def build_filters(snapshot: DataFrame, shards: int) -> DataFrame:
    """One binary fuse filter a shard of the snapshot's distinct digests (column ``_sha``)."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        f = BinaryFuse8.build(pdf["key"].to_numpy())
        return pd.DataFrame({"shard": [pdf["shard"].iloc[0]], "seed": [f.seed], "segment": [f.segment], "segments": [f.count], "slots": [f.slots.tobytes()]})

    return _digests(snapshot, shards).select("shard", "key").groupBy("shard").applyInPandas(build, _FILTER)


def screen(batch: DataFrame, filters: DataFrame, shards: int) -> DataFrame:
    """The batch's distinct digests that the snapshot's filters let through: all known ones, and about 1 in 256 others."""

    def probe(digests: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        if digests.empty or found.empty:
            return pd.DataFrame({"_sha": pd.Series([], dtype=object)})
        f = found.iloc[0]
        held = BinaryFuse8(int(f["seed"]), int(f["segment"]), int(f["segments"]), np.frombuffer(f["slots"], dtype=np.uint8))
        return digests.loc[held.contains(digests["key"].to_numpy()), ["_sha"]]

    return _digests(batch, shards).groupBy("shard").cogroup(filters.groupBy("shard")).applyInPandas(probe, "_sha binary")


@dataclass
class Snapshot:
    """An immutable set of documents (doc_id, _text), their digests (doc_id, _sha), and one filter a shard of these."""

    documents: DataFrame
    digests: DataFrame
    filters: DataFrame
    shards: int


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))


def _made(docs: DataFrame, digest: Callable[[Column], Column], keys_per_shard: int, kept: Callable[[DataFrame, str], DataFrame]) -> Snapshot:
    digests = kept(docs.select("doc_id", digest(F.col("_text")).alias("_sha")), "digests")
    shards = max(1, math.ceil(digests.count() / keys_per_shard))
    return Snapshot(docs, digests, kept(build_filters(digests, shards), "fuse"), shards)


def save_snapshot(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256, keys_per_shard: int = KEYS_PER_SHARD) -> Snapshot:
    """Hashes a snapshot and builds its filters, once, and keeps both in ``path``."""

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{path}/{name}")
        return df.sparkSession.read.schema(df.schema).parquet(f"{path}/{name}")

    return _made(_rows(docs, id_col, text_col), digest, keys_per_shard, kept)


def load_snapshot(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", keys_per_shard: int = KEYS_PER_SHARD) -> Snapshot:
    """What ``save_snapshot`` has kept of the same documents; nothing is hashed or built again."""
    digests, filters = (docs.sparkSession.read.parquet(f"{path}/{name}") for name in ("digests", "fuse"))
    return Snapshot(_rows(docs, id_col, text_col), digests, filters, max(1, math.ceil(digests.count() / keys_per_shard)))


def _places(sha: str | Column) -> list[Column]:
    return [F.pmod(F.xxhash64(sha, F.lit(k)), F.lit(SUSPECT_BITS)) for k in (2, 3)]


def suspected(rows: DataFrame, suspects: DataFrame) -> DataFrame:
    """The rows whose digest may be a suspect's: all that are and, while suspects are few beside the filter's bits, few
    others. The filter has a fixed size and is looked up where the rows lie, so that unique texts aren't shuffled."""
    places = suspects.select(F.explode(F.array(*_places("_sha"))).alias("p"))
    words = places.groupBy(F.expr("cast(p div 64 as int)").alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("p") % 64).cast("int"))).alias("b")).collect()
    bits = np.zeros(SUSPECT_BITS // 64, dtype=np.int64)
    for w, b in words:
        bits[w] = b
    held = rows.sparkSession.createDataFrame([(bits.tolist(),)], "_bits array<long>")
    hit = F.lit(True)
    for p in _places("_sha"):
        hit = hit & (F.call_function("shiftrightunsigned", F.col("_bits")[(p / 64).cast("int")], (p % 64).cast("int")).bitwiseAND(F.lit(1)) == 1)
    return rows.crossJoin(F.broadcast(held)).where(hit).drop("_bits")  # one row


def dedup_batch(batch: DataFrame, snapshot: Snapshot, *, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """Groups of equal texts over a kept snapshot and a batch, as ``exact_dedup`` gives them, with a row for each row of both.

    The batch is hashed; the snapshot's digests and filters are read as they were kept.
    """
    new_rows = _rows(batch, id_col, text_col)
    new = stage(new_rows.select("doc_id", digest(F.col("_text")).alias("_sha")), "digests")
    passed = stage(screen(new, snapshot.filters, snapshot.shards), "passed")
    tag = lambda df, n: df.select("*", F.lit(n).alias("_new"))
    narrow = tag(snapshot.digests, False).union(tag(new, True))
    base = tag(snapshot.documents, False).union(tag(new_rows, True)).withColumn("_sha", digest(F.col("_text")))

    # Texts are needed where a digest occurs twice in the snapshot, twice in the batch, or passed the filter.
    twice = narrow.groupBy("_new", "_sha").count().where("count > 1").select("_sha")
    # Staged: the join below must not take over the digest's partitioning, in which all copies of a text meet.
    suspects = stage(narrow.join(twice.union(passed).distinct(), "_sha", "left_semi").select("doc_id", "_sha").distinct(), "suspects")
    near = suspected(base, suspects)
    texts = near.join(suspects.hint("merge"), on=[near["doc_id"].eqNullSafe(suspects["doc_id"]), near["_sha"] == suspects["_sha"]], how="left_semi")

    def buckets(rows: DataFrame, tag: str) -> DataFrame:
        return rows.groupBy("_sha", "_text").agg(F.count(F.lit(1)).alias(f"n_{tag}"), F.max("doc_id").alias(f"top_{tag}"))

    both = buckets(texts.where("_new"), "new").join(buckets(texts.where("not _new"), "old"), ["_sha", "_text"], "full")
    n = F.coalesce("n_new", F.lit(0)) + F.coalesce("n_old", F.lit(0))
    known = both.select("_sha", F.sha2("_text", 512).alias("_class"), F.greatest("top_new", "top_old").alias("_keep"), n.alias("_n"))
    known = stage(known, "buckets")
    clash = stage(known.groupBy("_sha").count().where("count > 1").select("_sha"), "clash")

    if clash.isEmpty():
        out = narrow.join(known.select("_sha", "_keep", "_n"), "_sha", "left")
    else:  # digests that stand for several texts: their rows find their bucket by the bytes' own class
        odd = base.join(clash, "_sha", "left_semi").withColumn("_class", F.sha2("_text", 512)).join(known, ["_sha", "_class"], "left").select("_sha", "doc_id", "_keep", "_n")
        plain = narrow.join(clash, "_sha", "left_anti").join(known.select("_sha", "_keep", "_n"), "_sha", "left").select("_sha", "doc_id", "_keep", "_n")
        out = plain.union(odd)
    out = out.withColumn("keep_id", F.when(F.col("_n").isNull(), F.col("doc_id")).otherwise(F.col("_keep")))
    return out.select("doc_id", "keep_id", F.coalesce("_n", F.lit(1)).cast("long").alias("group_size"), F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False)).alias("kept"), F.lower(F.hex("_sha")).alias("text_sha256"))


def exact_dedup(docs: DataFrame, incoming: Column, *, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256, keys_per_shard: int = KEYS_PER_SHARD) -> DataFrame:
    """Groups of equal texts over a snapshot and a batch: the row with the largest id stays.

    ``incoming`` marks the batch; the other rows are the immutable snapshot. The snapshot's digests become binary fuse
    filters, one a shard (``save_snapshot`` keeps them for later batches, ``dedup_batch``). A batch digest that its filter
    refuses is new for certain; what passes is joined with the snapshot's exact buckets (digest and bytes). Copies inside
    the batch are grouped apart from that. Bytes are compared wherever two rows share a digest, so that colliding digests
    give separate groups; a digest that occurs once needs no text, and a filter of the suspects' digests keeps its text
    where it lies. Copies are combined before each shuffle; the last join meets a hot digest, which adaptive execution
    splits.

    Defined cases: a null text counts as empty; very long texts are hashed and compared whole; rows that tie for the largest
    id (a repeated one) all stay; null ids are kept as rows (the largest non-null id of a group stays, and
    a group of null ids only keeps none); rows that repeat an id each give a row; an empty table gives an empty result;
    other columns are ignored. Returns doc_id, keep_id, group_size, kept, text_sha256.
    """
    new = F.coalesce(incoming, F.lit(True))
    snapshot = _made(_rows(docs.where(~new), id_col, text_col), digest, keys_per_shard, stage)
    return dedup_batch(docs.where(new), snapshot, id_col=id_col, text_col=text_col, digest=digest)


def batch_rule(id_col: str = "doc_id") -> Column:
    """The query's split: a quarter of the ids, by hash, plays the incoming batch; the rest is the snapshot."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 3


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read_table(spark, sf_dir, "documents"), batch_rule())


OP2_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g ON d.t = g.t
"""
