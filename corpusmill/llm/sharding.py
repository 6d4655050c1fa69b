"""Sharding by rendezvous hashing: every key asks all weighted shards and goes to the one that bids most. JVM functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import crc_sql, read_table, stage, utf8_bytes_sql

SHARDS = 24
#: Rows of a numbering task, and copies of one row that a task gives out, about.
BUCKET, COPIES = 10_000, 100_000
#: Hexadecimal digits of a hash that make a number without rounding in a double.
_DIGITS = 13


def _number(hashed: Column) -> Column:
    return F.conv(F.substring(hashed, 1, _DIGITS), 16, 10).cast("double")


def shard_of(key: Column | str, weights: Sequence[float] | int = SHARDS) -> Column:
    """The shard of a key among shards of the given weights, or so many equal ones; a null key is a key of its own.

    Shard i bids -w / ln(u), u being a hash of the key and i within 0 to 1: it wins a share of keys in proportion to its
    weight. A bid depends on no other shard, so that one more shard takes keys only into itself, one less gives away only
    its own, and another weight moves keys only to or from its shard. A tie goes to the later shard. A shard of weight 0
    gets nothing.
    """
    weights = [1.0] * weights if isinstance(weights, int) else [float(w) for w in weights]
    if not any(w > 0 for w in weights) or min(weights) < 0:
        raise ValueError("weights must not be negative, and one must be above 0")
    text = F.coalesce((F.col(key) if isinstance(key, str) else key).cast("string"), F.lit(""))
    hashed = [(i, w, F.md5(F.concat(F.lit(f"{i}:"), text).cast("binary"))) for i, w in enumerate(weights) if w > 0]
    if len({w for _, w, _ in hashed}) == 1:  # equal weights: the greatest hash bids most
        bids = [F.struct(F.substring(h, 1, _DIGITS).alias("bid"), F.lit(i).alias("shard")) for i, _, h in hashed]
    else:
        bids = [F.struct((F.lit(-w) / F.ln((_number(h) + 0.5) / float(16**_DIGITS))).alias("bid"), F.lit(i).alias("shard")) for i, w, h in hashed]
    return (F.greatest(*bids) if len(bids) > 1 else bids[0])["shard"]


def sized(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size (bytes of the text and 8 for the id) and text_crc32 of each row; a null text has no bytes."""
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))


def number_slots(rows: DataFrame, bucket: int = BUCKET, copies: int = COPIES) -> DataFrame:
    """Adds slot, gapless from 0 within each shard, to rows with a column ``shard``: ordered by a hash of the whole row.

    Equal rows are one row with a number before they are shuffled, so that no group of copies meets in one task. The rest
    is dealt into buckets by the first bits of the hash, numbered there, and shifted by the buckets before it. Rows that
    stand for many copies are given out in parts.
    """
    columns = rows.columns
    text = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in columns))
    counted = rows.groupBy(columns).agg(F.count(F.lit(1)).alias("_n")).withColumn("_hash", F.md5(text.cast("binary")))
    counted = stage(counted, "rows")
    buckets = max(1, counted.count() // bucket)
    counted = counted.withColumn("_bucket", F.floor(_number(F.col("_hash")) / float(16**_DIGITS) * buckets).cast("long"))
    order = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    sums = counted.groupBy("shard", "_bucket").agg(F.sum("_n").alias("_s"))
    sums = stage(sums.select("shard", "_bucket", (F.sum("_s").over(order) - F.col("_s")).alias("_before")), "buckets")
    within = Window.partitionBy("shard", "_bucket").orderBy("_hash", *columns).rowsBetween(Window.unboundedPreceding, 0)
    placed = counted.withColumn("_first", F.sum("_n").over(within) - F.col("_n")).join(sums, ["shard", "_bucket"])
    placed = stage(placed.select(*columns, "_n", (F.col("_first") + F.col("_before")).alias("_first")), "placed")
    once = placed.where("_n = 1").select(*columns, F.col("_first").alias("slot"))
    parts = placed.where("_n > 1").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(_n - 1) div {copies}"))).alias("_p"))
    parts = parts.withColumn("_left", F.least(F.lit(copies), F.col("_n") - F.col("_p") * copies)).hint("rebalance")
    each = parts.select(*columns, "_first", "_p", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_left") - 1)).alias("_k"))
    return once.union(each.select(*columns, F.col("_first") + F.col("_p") * copies + F.col("_k")))


def shard_documents(docs: DataFrame, weights: Sequence[float] | int = SHARDS, grown: Sequence[float] | int | None = None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Puts documents into weighted shards by their ids, and says where each would be with one shard more.

    The law is ``key``: an id and the weights decide, whatever else the table holds. ``grown`` are the weights after
    growth; unless given, one more shard of the last one's weight.

    Defined cases: rows that share an id share a shard, whatever their texts; rows with a null id are one key; null and
    empty texts have 8 bytes; very long texts are read once, where they lie, and never shuffled; ties of a shard's order go
    by the columns, and equal rows take any of their slots; an empty table gives an empty result; other columns are
    ignored. Returns doc_id, size, text_crc32, law, shard, slot, grown_shard.
    """
    weights = [1.0] * weights if isinstance(weights, int) else list(weights)
    grown = [*weights, weights[-1]] if grown is None else grown
    rows = sized(docs, id_col=id_col, text_col=text_col)
    rows = rows.withColumns({"shard": shard_of("doc_id", weights), "grown_shard": shard_of("doc_id", grown)})
    return number_slots(rows).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def write_shards(docs: DataFrame, path: str, weights: Sequence[float] | int = SHARDS, *, id_col: str = "doc_id", files: int = 1) -> None:
    """Writes all rows with all their columns as Parquet into ``path``/shard=0, 1 and so on, each in about so many files."""
    rows = docs.withColumn("shard", shard_of(id_col, weights))
    part = F.when(F.lit(files) > 1, F.pmod(F.xxhash64(*docs.columns), F.lit(files))).otherwise(0)
    rows.withColumn("_file", part).repartition("shard", "_file").drop("_file").write.partitionBy("shard").parquet(path)


def op13_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(read_table(spark, sf_dir, "documents"))


def _sql_shard(shards: int) -> str:
    bids = [f"substr(md5('{i}:' || coalesce(doc_id::VARCHAR, '')), 1, {_DIGITS}) || ' {i:03d}'" for i in range(shards)]
    return f"right(greatest({', '.join(bids)}), 3)::INT"


OP13_SQL = f"""
WITH d AS (
  SELECT doc_id, (octet_length(encode(coalesce(text, ''))) + 8)::BIGINT AS size, {crc_sql(utf8_bytes_sql("coalesce(text, '')"))} AS text_crc32,
    {_sql_shard(SHARDS)} AS shard, {_sql_shard(SHARDS + 1)} AS grown_shard
  FROM documents),
h AS (SELECT *, md5(concat_ws('|', coalesce(doc_id::VARCHAR, '-'), size, text_crc32, shard, grown_shard)) AS hash FROM d)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY hash) - 1 AS slot, grown_shard FROM h
"""
