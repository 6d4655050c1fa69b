"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..staging import stage

__all__ = ["connected_components", "mix64", "number_in_order", "read_table", "stage"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), element by element."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def _forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The edges of one partition as stars about the least node of each of its trees."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root.setdefault(up, up)
        return x

    for pdf in batches:
        for u, v in zip(pdf["_u"].tolist(), pdf["_v"].tolist()):
            if (a := find(u)) != (b := find(v)):
                root[max(a, b)] = min(a, b)
    stars = [(x, r) for x in root if (r := find(x)) != x]
    yield pd.DataFrame(stars, columns=["_u", "_v"], dtype="int64")


def connected_components(edges: DataFrame, src: str = "a", dst: str = "b", rounds: int = 200) -> DataFrame:
    """Components of an undirected edge list as rows (node, component), the component being its smallest node.

    Contraction in rounds. Each partition first replaces its own edges by stars with the same components, which bounds
    them by its nodes. Then every node moves to the least of its closed neighbourhood, by number and by a fresh hash in
    turn: the first contracts a star at once, the second shortens a chain of any order by a constant factor in
    expectation. Edges are rewritten between the images; loops and repeats go. Nodes without an edge are not returned.
    Null ends are ignored. A star's centre is one key of the joins, which adaptive execution splits; the minima are
    combined before the shuffle.
    """
    e = edges.select(F.col(src).cast("long").alias("_u"), F.col(dst).cast("long").alias("_v")).where("_u is not null and _v is not null and _u <> _v")
    e = stage(e.mapInPandas(_forest, "_u long, _v long").distinct(), "edges")
    images: list[DataFrame] = []
    while not e.isEmpty():
        if len(images) == rounds:
            raise RuntimeError(f"edges remain after {rounds} rounds of contraction")
        k = len(images)
        rank = lambda c, k=k: F.struct((F.xxhash64(F.col(c), F.lit(k)) if k % 2 else F.col(c)).alias("h"), F.col(c).alias("n"))
        both = e.union(e.select("_v", "_u"))
        image = both.groupBy("_u").agg(F.min(rank("_v")).alias("m")).select("_u", F.least(rank("_u"), F.col("m"))["n"].alias("_to"))
        image = stage(image, "image")
        images.append(image)
        left = image.select(F.col("_u"), F.col("_to").alias("_x"))
        right = image.select(F.col("_u").alias("_v"), F.col("_to").alias("_y"))
        nxt = e.join(left, "_u").select("_x", "_v").join(right, "_v").where("_x <> _y")
        nxt = nxt.select(F.col("_x").alias("_u"), F.col("_y").alias("_v"))
        e = stage(stage(nxt, "rewritten").mapInPandas(_forest, "_u long, _v long"), "edges")
    if not images:
        return e.select(F.col("_u").alias("node"), F.col("_v").alias("component"))
    moved = images[0].select(F.col("_u").alias("node"), F.col("_to").alias("root"))
    for image in images[1:]:
        moved = moved.join(image.withColumnRenamed("_u", "root"), "root", "left").select("node", F.coalesce("_to", "root").alias("root"))
    moved = stage(moved, "nodes")
    least = moved.groupBy("root").agg(F.min("node").alias("component"))
    return stage(moved.join(least, "root").select("node", "component"), "components")


def number_in_order(rows: DataFrame, *order: str, name: str = "_at") -> DataFrame:
    """Adds the place of each row, from 0, in the order of the columns: nulls first, strings bytewise.

    Rows are dealt by ranges and numbered apart; each range is shifted by the rows of those before it, of which there are
    as many as shuffle partitions. No key is held together: the last column should tell rows apart, so that equal keys can
    be cut between ranges as well.
    """
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = stage(dealt.withColumn("_part", F.spark_partition_id()).withColumn("_in", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "ranges")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return dealt.join(F.broadcast(sizes), "_part").withColumn(name, F.col("_before") + F.col("_in")).drop("_part", "_in", "_before")


def _crc_of_bit(k: int) -> int:
    """The polynomial's remainder of a byte that has one bit."""
    c = 1 << k
    for _ in range(8):
        c = (c >> 1) ^ (0xEDB88320 if c & 1 else 0)
    return c


def crc_sql(octets: str) -> str:
    """SQL of the unsigned crc32 of a list of bytes, which DuckDB lacks; the remainder of a byte is that of its bits together."""
    low = "(xor(crc, octet) & 255)"
    step = "crc >> 8"
    for k in range(8):
        step = f"xor({step}, (({low} >> {k}) & 1) * {_crc_of_bit(k)})"
    return f"xor(list_reduce({octets}, lambda crc, octet: {step}, 4294967295::BIGINT), 4294967295)"


def decimal_bytes_sql(number: str) -> str:
    """SQL of the bytes of an integer's decimal text."""
    return f"list_transform(string_split({number}::VARCHAR, ''), lambda c: ascii(c)::BIGINT)"


def utf8_bytes_sql(text: str) -> str:
    """SQL of the bytes of a text, made from its code points."""
    tail = lambda down: f"(128 | ((u >> {down}) & 63))"
    octets = f"CASE WHEN u < 128 THEN [u] WHEN u < 2048 THEN [192 | (u >> 6), {tail(0)}] WHEN u < 65536 THEN [224 | (u >> 12), {tail(6)}, {tail(0)}] ELSE [240 | (u >> 18), {tail(12)}, {tail(6)}, {tail(0)}] END"
    return f"CASE WHEN {text} = '' THEN [] ELSE flatten(list_transform(list_transform(string_split({text}, ''), lambda c: unicode(c)::BIGINT), lambda u: {octets})) END"
