"""Sketches a section that are kept and merged: a batch adds to them, and no old row is read again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Log2 of the registers of distinct counts (error about 1.04 / 2 ** (this / 2)), size of quantile sketches (rank error about 1.3 %).
REGISTERS, QUANTILES = 14, 200


def section_sketches(rows: DataFrame, *, section: str, distinct: Column, amount: Column) -> DataFrame:
    """(section, rows, distinct_sketch, amount_sketch) of a batch: combined within tasks before they are shuffled, so that a hot
    section is no task's burden. Nulls of either column aren't counted in its sketch; a null section is one of its own."""
    held = rows.select(F.col(section).alias("section"), distinct.alias("_d"), amount.cast("long").alias("_a"))
    sums = F.count(F.lit(1)).alias("rows"), F.hll_sketch_agg("_d", REGISTERS).alias("distinct_sketch"), F.expr(f"kll_sketch_agg_bigint(_a, {QUANTILES})").alias("amount_sketch")
    return held.groupBy("section").agg(*sums)


def merged(*sketches: DataFrame) -> DataFrame:
    """One row a section from the rows of all tables, which may have been kept by earlier runs."""
    every = sketches[0]
    for s in sketches[1:]:
        every = every.unionByName(s)
    return every.groupBy("section").agg(F.sum("rows").alias("rows"), F.hll_union_agg("distinct_sketch").alias("distinct_sketch"), F.expr("kll_merge_agg_bigint(amount_sketch)").alias("amount_sketch"))


def estimates(sketches: DataFrame, quantiles: tuple[float, ...] = (0.5, 0.9)) -> DataFrame:
    """(section, rows, distinct, q50, q90, ...): what the sketches say."""
    some = F.expr("kll_sketch_get_n_bigint(amount_sketch) > 0")  # a sketch of nothing has no quantiles
    qs = [F.when(some, F.expr(f"kll_sketch_get_quantile_bigint(amount_sketch, {q}D)")).alias(f"q{round(q * 100)}") for q in quantiles]
    return sketches.select("section", "rows", F.hll_sketch_estimate("distinct_sketch").alias("distinct"), *qs)
