"""Mixing sources to target weights by hash thresholds, found in histograms and refined at the boundary only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, stage

#: A document's hash has 60 bits; each refinement fixes this many more of them.
HASH_BITS, STEP_BITS = 60, 12


def word_count(text: Column) -> Column:
    r"""Runs of other characters than space and \x09-\x0D; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def document_hash(id_col: str) -> Column:
    """60 bits of the id's MD5: the same on every run and in every engine."""
    return F.conv(F.substring(F.md5(F.col(id_col).cast("string").cast("binary")), 1, 15), 16, 10).cast("long")


def source_targets(sources: DataFrame, budget_share: float = 1.5, cap: float = 2.0, weights: tuple[int, ...] = (3, 1, 2)) -> DataFrame:
    """Targets of sources (column ``source``, ``source_size``): budget by weight, none above ``cap`` times its size.

    Sources in code-point order, null last, get the weights in turn. What a capped source can't take is shared by the
    others by weight until none is above its cap: each round is one global sum, and the number of rounds is at most the
    number of times that the shared level rises past a cap, a handful. Sources of size 0 get 0.
    """
    spark = sources.sparkSession
    ranked = sources.orderBy(F.col("source").isNull(), F.col("source")).rdd.zipWithIndex().map(lambda x: (x[0]["source"], x[0]["source_size"], x[1]))
    t = spark.createDataFrame(ranked, "source string, source_size long, _rank long")
    t = stage(t.withColumn("_w", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod("_rank", F.lit(len(weights))) + 1).cast("int"))), "sources")
    total = t.agg(F.sum("source_size")).first()[0] or 0
    budget, level, full = min(budget_share, cap) * total, 0.0, F.lit(False)
    while True:  # the level at which unsaturated sources share what saturated ones leave
        fixed, open_w = t.agg(F.sum(F.when(full, cap * F.col("source_size")).otherwise(0.0)), F.sum(F.when(full, 0).otherwise(F.col("_w")))).first()
        if not open_w or (new := (budget - fixed) / open_w) <= level:
            break
        level = new
        full = F.col("_w") * F.lit(level) >= cap * F.col("source_size")
    return t.select("source", "source_size", F.least(F.col("_w") * F.lit(level), cap * F.col("source_size")).cast("double").alias("target"))


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", budget_share: float = 1.5, cap: int = 2, weights: tuple[int, ...] = (3, 1, 2), with_source: bool = False) -> DataFrame:
    """How many words of each document a mix takes so that every source comes near its target.

    A source whose target is r times its size takes each document floor(r) times, and once more those documents whose
    hash lies below the source's threshold. The threshold is the highest hash up to which the additional words stay
    within the rest of the target. It is found without sorting: words are summed by source and the leading bits of the
    hash, the bucket in which the running sum passes the budget is found in each source, and only that bucket is summed
    anew by its next bits, until all bits are fixed. Rows of one hash (the same id) go together.

    Defined cases: null text has size 0; very long texts are counted whole and may alone exceed a small source's target, so
    that it takes none; rows that tie by hash go together; the null source is a source of its own, last in order; an empty table gives an
    empty result; rows with a null id share one hash; other columns are ignored. Returns doc_id, size, source_size,
    target, taken, and on demand source.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"), F.coalesce(document_hash(id_col), F.lit(0)).alias("_h"))
    base = stage(base, "sizes")
    sums = base.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sums, budget_share, cap, weights)
    share = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(cap))).otherwise(0)
    # _below: hashes under it are in; it grows by one boundary bucket's start in each refinement. _rest: words still free.
    state = targets.withColumn("_copies", share.cast("long")).withColumn("_below", F.lit(0).cast("long")).withColumn("_rest", F.col("target") - F.col("_copies") * F.col("source_size"))
    state = stage(state, "thresholds")
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    left, inside = HASH_BITS, base
    while left:
        left = max(0, left - STEP_BITS)
        width = 1 << left
        histogram = inside.groupBy("source", F.shiftright("_h", left).alias("_bucket")).agg(F.sum("size").alias("_words"), F.min("_h").alias("_lo"), F.max("_h").alias("_hi"))
        # 2**STEP_BITS buckets a source at most: the running sum is over buckets, not rows.
        running = histogram.selectExpr("source", "_bucket", "_lo", "_hi", "sum(_words) over (partition by source order by _bucket) as _sum")
        fits = running.join(state.select(F.col("source").alias("_s"), "_rest"), F.col("source").eqNullSafe(F.col("_s")))
        last = fits.groupBy("source").agg(F.coalesce(F.max(F.when(F.col("_sum") <= F.col("_rest"), F.col("_sum"))), F.lit(0)).alias("_used"), F.min(F.when(F.col("_sum") > F.col("_rest"), F.struct("_bucket", "_lo", "_hi"))).alias("_at")).withColumnRenamed("source", "_s")
        after = state.join(last, F.col("source").eqNullSafe(F.col("_s")), "left")
        # No boundary bucket: all that was looked at fits, and the threshold lies behind it.
        # A boundary bucket that holds one hash alone needs no refinement: that hash is the threshold.
        one = F.col("_at._lo") == F.col("_at._hi")
        below = F.when(one, F.col("_at._lo")).when(F.col("_at").isNotNull(), F.col("_at._bucket") * F.lit(width)).when(F.col("_s").isNotNull(), F.lit((1 << HASH_BITS))).otherwise(F.col("_below"))
        after = after.select("source", "source_size", "target", "_copies", below.alias("_below"), (F.col("_rest") - F.coalesce("_used", F.lit(0))).alias("_rest"), F.when(~one, F.col("_at._bucket")).alias("_edge"))
        state = stage(after, "thresholds")
        if state.where("_edge is not null").isEmpty():
            left = 0
        if left:
            edges = state.where("_edge is not null").select(F.col("source").alias("_s"), F.col("_edge").alias("_e"))
            inside = stage(inside.withColumn("_b", F.shiftright("_h", left)).join(edges, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_b") == F.col("_e")), "left_semi").drop("_b"), "boundary")
        state = state.drop("_edge")
    picked = state.select(F.col("source").alias("_s"), "source_size", "target", "_copies", "_below")
    out = base.join(picked, F.col("source").eqNullSafe(F.col("_s")))
    times = F.least(F.col("_copies") + (F.col("_h") < F.col("_below")).cast("long"), F.lit(cap))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * times).alias("taken"), *(["source"] if with_source else []))


def op6_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read_table(spark, sf_dir, "documents"))


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         ('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15))::BIGINT AS h
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [3, 1, 2][1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3] AS w
  FROM d GROUP BY source),
o AS (  -- in the order in which sources reach their caps as the level rises
  SELECT *, 1.5 * sum(source_size) OVER () AS budget, 2.0 * source_size / w AS caps_at,
         coalesce(sum(2.0 * source_size) OVER (ORDER BY 2.0 * source_size / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
         sum(w) OVER (ORDER BY 2.0 * source_size / w, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_w
  FROM s),
l AS (SELECT arg_min((budget - before) / open_w, caps_at) AS level FROM o WHERE (budget - before) / open_w <= caps_at),
t AS (SELECT o.source, source_size, least(w * level, 2.0 * source_size) AS target FROM o, l),
c AS (SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 2) ELSE 0 END AS copies FROM t),
r AS (
  SELECT d.*, c.source_size, c.target, c.copies, sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h) AS upto
  FROM d JOIN c ON d.source IS NOT DISTINCT FROM c.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, CAST(target AS DOUBLE) AS target,
       CAST(size * least(copies + CASE WHEN upto <= target - copies * source_size THEN 1 ELSE 0 END, 2) AS BIGINT) AS taken
FROM r
"""
