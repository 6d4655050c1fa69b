"""Empty headings of Markdown texts and the quality figures made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import WORD, strip

#: Fixed value: most documents with an empty heading, in percent.
EMPTY_HEADING_LIMIT = 10.0


def empty_headings(docs: DataFrame, *, key: str, body: str, naive: bool = False) -> DataFrame:
    """(key, pos, level, title) of headings of level 2 or more with nothing but blank lines before the next heading, which
    is of the same level or a higher one (of any level if ``naive``). The last heading of a text is never empty.

    Everything is done within the row: the next heading of each, and a running count of lines that hold something.
    """
    rows = docs.select(F.col(key), F.split(F.col(body), "\n").alias("_l"))
    rows = rows.withColumn("_lv", F.expr("transform(_l, x -> length(regexp_extract(x, '^(#{2,})[ \\\\t\\\\r\\\\f]+[^ \\\\t\\\\r\\\\f]', 1)))"))
    rows = rows.withColumn("_full", F.expr(f"transform(_l, x -> regexp_like(x, '{WORD}'))".replace("\\", "\\\\")))
    rows = rows.withColumn("_h", F.expr("filter(sequence(0, size(_l) - 1), i -> _lv[i] > 0)"))
    test = "not exists(slice(_full, _h[k] + 2, _h[k + 1] - _h[k] - 1), x -> x)" + ("" if naive else " and _lv[_h[k + 1]] <= _lv[_h[k]]")
    rows = rows.withColumn("_e", F.expr(f"transform(filter(case when size(_h) > 1 then sequence(0, size(_h) - 2) else array() end, k -> {test}), k -> _h[k])"))
    out = rows.select(key, F.explode_outer("_e").alias("pos"), "_l", "_lv").where("pos is not null")
    return out.select(key, "pos", F.expr("_lv[pos]").alias("level"), strip(F.regexp_replace(F.expr("_l[pos]"), "^#+", "")).alias("title"))


def empty_heading_summary(found: DataFrame, documents: DataFrame, *, key: str, limit: float = EMPTY_HEADING_LIMIT) -> DataFrame:
    """One row: documents with an empty heading, documents, percentage (0 if there are none), empty headings, verdict."""
    one = found.agg(F.count_distinct(key).alias("docs_with_empty"), F.count(F.lit(1)).alias("empty_total"))
    every = documents.agg(F.count(F.lit(1)).alias("docs"))
    pct = F.when(F.col("docs") > 0, F.col("docs_with_empty") / F.col("docs") * 100).otherwise(F.lit(0.0))
    return one.join(every).select("docs_with_empty", "docs", pct.alias("empty_pct"), "empty_total", F.when(pct > limit, "CAUTION").otherwise("NOTE").alias("severity"))


def top_titles(found: DataFrame, n: int = 10, *, order: list[str]) -> DataFrame:
    """The most frequent titles; ties by their first appearance."""
    counted = found.groupBy("title").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*order)).alias("_first"))
    return counted.orderBy(F.desc("n"), "_first").limit(n).select("title", "n")
