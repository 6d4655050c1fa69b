"""Figures of a run and the Markdown report made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import report_cell
from ..staging import stage
from .embedding import estimate_cost
from .headings import EMPTY_HEADING_LIMIT


def token_stats(chunks: DataFrame, tokens: str = "token_count") -> DataFrame:
    """Least, greatest and (truncated) median; nulls for no chunk."""
    return chunks.agg(F.min(tokens).alias("min_tokens"), F.max(tokens).alias("max_tokens"), F.median(tokens).cast("int").alias("median_tokens"))


def word_count_stats(docs: DataFrame, words: str = "word_count") -> DataFrame:
    return docs.agg(F.min(words).alias("min_words"), F.max(words).alias("max_words"), F.round(F.avg(words), 1).alias("mean_words"), F.median(words).cast("int").alias("median_words"), F.count(words).alias("n"))


def section_distribution(chunks: DataFrame, section: str = "section") -> DataFrame:
    return chunks.groupBy(section).agg(F.count(F.lit(1)).alias("chunks"))


def doc_chunk_counts(chunks: DataFrame, key: str = "doc_url") -> DataFrame:
    return chunks.groupBy(key).agg(F.count(F.lit(1)).alias("chunks"))


def status_by_section(documents: DataFrame) -> DataFrame:
    return documents.groupBy("section").agg(F.count(F.lit(1)).alias("in_manifest"), F.count_if(F.col("status").isin("success", "skipped")).alias("with_markdown"))


def index_dry_run(chunks: DataFrame, model: str, *, section: str = "section") -> DataFrame:
    """Per section: documents, chunks, tokens, their spread and the cost of embedding them."""
    out = chunks.groupBy(section).agg(F.count_distinct("doc_id").alias("docs"), F.count(F.lit(1)).alias("chunks"), F.sum("token_count").alias("tokens"), F.min("token_count").alias("min_tokens"), F.max("token_count").alias("max_tokens"))
    return out.withColumn("cost_usd", estimate_cost(F.col("tokens"), model))


def report_listing(documents: DataFrame) -> DataFrame:
    """Rows of the report, numbered in (section, url) order.

    Rows are dealt by ranges of that order, however large a section is; each range is numbered on its own and shifted by
    the rows of earlier ranges, of which there are as many as shuffle partitions.
    """
    order = "section, url, title, word_count"
    # Staged, as dealing by ranges reads its input twice.
    ranged = stage(documents.select("section", "word_count", "title", "url"), "rows").repartitionByRange("section", "url", "title")
    ranged = stage(ranged.withColumn("_range", F.spark_partition_id()), "listing")
    before = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).selectExpr("_range", "sum(_n) over (order by _range) - _n as _before")
    rows = ranged.selectExpr("*", f"row_number() over (partition by _range order by {order}) as _k").join(before, "_range")
    return rows.select((F.col("_before") + F.col("_k")).alias("n"), "section", "word_count", report_cell("title").alias("title"), "url")


def render_report(manifest: dict, sections: list, words: dict, empty: dict, titles: list, listing: list, failed: list) -> str:
    """Markdown of collected figures; listings are those of a bounded sample."""
    share = f"**{empty['empty_pct']:.1f}%** of the documents have an empty heading (limit {EMPTY_HEADING_LIMIT:.0f}%)."
    verdict = f"> [!{empty['severity']}]\n> {share}"
    out = ["# Dataset report", "", "Figures of one run, made from its manifest and the Markdown that it left.", ""]
    out += ["## Figures", "", verdict, "", "| Figure | Value |", "| --- | --- |", *[f"| {k} | {v} |" for k, v in manifest.items()], ""]
    out += ["## Sections", "", "| Section | In manifest | With Markdown |", "| --- | ---: | ---: |", *[f"| `{r['section']}` | {r['in_manifest']} | {r['with_markdown']} |" for r in sections], ""]
    out += ["## Words of documents with Markdown", "", "| Figure | Value |", "| --- | ---: |", *[f"| {k} | {v} |" for k, v in words.items()], ""]
    out += ["## What an empty heading is", "", "1. Nothing but blank lines stands between it and the next heading.", "2. The next heading has the same level or a higher one.", ""]
    out += ["### Why the second condition", "", "A parent heading that goes straight to its first child is no gap; without the condition it would count as one.", "", share, ""]
    out += ["## Empty headings", "", verdict, "", "| Figure | Value |", "| --- | ---: |", f"| Documents | {empty['docs_with_empty']} / {empty['docs']} |", f"| Headings | {empty['empty_total']} |", ""]
    if titles:
        out += ["| Frequency | Title |", "| ---: | --- |", *[f"| {r['n']} | `{r['title']}` |" for r in titles], ""]
    out += ["## Documents", "", "| # | Section | Words | Title | Address |", "| ---: | --- | ---: | --- | --- |", *[f"| {r['n']} | `{r['section']}` | {r['word_count']} | {r['title']} | <{r['url']}> |" for r in listing], ""]
    if failed:
        out += ["## Failed", "", "| Address | Error |", "| --- | --- |", *[f"| <{r['url']}> | {r['error_message'] or '—'} |" for r in failed], ""]
    return "\n".join(out)


def corpus_cube(chunks: DataFrame, *, doc: str, by: list[str], tokens: str = "token_count") -> DataFrame:
    """Documents, chunks and tokens by every combination of the columns, with ``level``, the number that tells which are
    summed over. A document has one value of each column: its chunks are summed first, so that no grouping counts distinct
    values and only a row a document is multiplied by the groupings."""
    per_doc = chunks.groupBy(doc, *by).agg(F.count(F.lit(1)).alias("_c"), F.sum(tokens).alias("_t"))
    return per_doc.cube(*by).agg(F.grouping_id().cast("long").alias("level"), F.count(F.lit(1)).alias("docs"), F.sum("_c").alias("chunks"), F.sum("_t").cast("long").alias("tokens"))
