"""Joins of intervals: each is put into the buckets of time that it touches, and meets only what shares one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..staging import stage

#: Rows of one side that a bucket's part holds, about; right rows of a key from which on its intervals are put into buckets.
PART, FEW = 2000, 100


def _micros(c: str) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp"))


def _ends(rows: DataFrame, start: str, end: str, width: int, tag: str) -> DataFrame:
    """Rows that can meet something; ``tag`` with the ends as microseconds and the first and last bucket."""
    first, last = (F.floor(_micros(c) / width).cast("long") for c in (start, end))
    good = rows.where(F.col(start) <= F.col(end))  # null ends and ends before starts meet nothing
    return good.select("*", _micros(start).alias(f"_{tag}s"), _micros(end).alias(f"_{tag}e"), first.alias(f"_{tag}f"), last.alias(f"_{tag}t"))


def interval_join(left: DataFrame, right: DataFrame, *, on: list[str], left_ends: tuple[str, str], right_ends: tuple[str, str], width: str = "30 days", part: int = PART, few: int = FEW) -> DataFrame:
    """All pairs of rows with equal ``on`` whose closed intervals have a moment in common, with the columns of both.

    Sides share no column names but those in ``on``, which may be empty; null keys meet nothing. Keys with at most ``few``
    intervals at the right (and ``part`` at the left) have one bucket. Of others an interval is copied into every bucket of ``width`` that it touches; a
    pair is given out only in the first bucket that both touch, so that none comes twice. The right side of a crowded bucket
    is dealt over parts, and the left side goes to all of them, so that no task holds more than a part's share. Buckets should
    be about as wide as the intervals are long: an interval has as many copies as it touches. Only the keys and buckets that
    are many rows' are tables of their own, so that rows are shuffled once.
    """
    spark = left.sparkSession
    seconds = spark.range(1).select(F.expr(f"cast(unix_micros(timestamp'1970-01-01 00:00:00+00:00' + interval {width}) as long)")).first()[0]
    a, b = _ends(left, *left_ends, seconds, "l"), _ends(right, *right_ends, seconds, "r")
    crowded = lambda x, n: x.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > n).select(*on)
    many = crowded(b, few).union(crowded(a, part)).distinct() if on else spark.range(1).select()
    many = stage(many.withColumn("_many", F.lit(True)), "many")
    if not on:
        a, b = (x.withColumn("_many", F.lit(True)) for x in (a, b))
    elif many.isEmpty():
        a, b = (x.withColumn("_many", F.lit(False)) for x in (a, b))
    else:
        a, b = (x.join(many, on, "left") for x in (a, b))
    # (Bucket 0 of a key with few intervals is no bucket of time.)
    spread = lambda x, tag: x.withColumn("_bucket", F.explode(F.when(F.col("_many"), F.sequence(f"_{tag}f", f"_{tag}t")).otherwise(F.array(F.lit(0).cast("long")))))
    a, b = spread(a, "l").withColumnRenamed("_many", "_buckets"), spread(b, "r")
    key = [*on, "_bucket"]
    parts = b.where("_many").groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / part).cast("int").alias("_parts")).where("_parts > 1")
    parts = stage(parts, "parts")
    names = [c for c in right.columns if c not in on]
    if parts.isEmpty():
        a, b = (x.withColumn("_part", F.lit(0)) for x in (a, b))
    else:
        n = F.coalesce("_parts", F.lit(1))
        b = b.join(parts, key, "left").withColumn("_part", F.pmod(F.xxhash64(*on, *right_ends, *names), n).cast("int"))
        a = a.join(parts, key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), n - 1)))
    a = a.select(*left.columns, "_ls", "_le", "_lf", "_buckets", "_bucket", "_part")
    b = b.select(*right.columns, "_rs", "_re", "_rf", "_bucket", "_part")
    met = a.join(b, [*key, "_part"]).where("_ls <= _re and _rs <= _le and (not coalesce(_buckets, false) or _bucket = greatest(_lf, _rf))")
    return met.select(*on, *(c for c in left.columns if c not in on), *names)
