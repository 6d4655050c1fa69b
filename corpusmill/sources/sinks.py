"""Writers: raw pages, Markdown files, manifests and the run report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import front_matter
from ..staging import stage


def write_raw_pages(pages: DataFrame, path: str, order: str = "page_id") -> None:
    """Raw pages by slug, before any extraction, so that failed ones keep theirs; of a repeated slug, the last one."""
    last = F.max_by(F.struct("url", "html"), F.struct(order, "url", "html")).alias("_p")
    pages.groupBy("slug").agg(last).select("slug", "_p.*").write.mode("overwrite").parquet(path)


def markdown_files(docs: DataFrame) -> DataFrame:
    """slug and full text: front matter, body, and one more line end."""
    return docs.select("slug", F.concat(front_matter("url", "title", "section", "scraped_at", "word_count"), F.col("body"), F.lit("\n")).alias("md"))


_DOCUMENT = ["url", "title", "section", "html_raw_path", "markdown_path", "scraped_at", "word_count", "status", "error_message"]


def manifest_counters(documents: DataFrame, discovered: int, seconds: float) -> DataFrame:
    counts = [F.count_if(F.col("status") == s).alias(f"total_{n}") for s, n in (("success", "downloaded"), ("failed", "failed"), ("skipped", "skipped"))]
    return documents.agg(F.lit(discovered).alias("total_discovered"), *counts, F.lit(float(seconds)).alias("duration_seconds"))


def write_manifest(documents: DataFrame, path: str, discovered: int, seconds: float, order: str = "ord") -> None:
    """Counters as one JSON line in ``counters``, documents as JSON lines in ``documents``, dealt by ranges of their order."""
    # Staged, as dealing by ranges and counting read the documents three times.
    documents = stage(documents.select(*dict.fromkeys([order, *_DOCUMENT])), "manifest")
    rows = documents.select(F.col(order).alias("ord"), *_DOCUMENT).repartitionByRange("ord").sortWithinPartitions("ord")
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{path}/documents")
    manifest_counters(documents, discovered, seconds).write.mode("overwrite").json(f"{path}/counters")
