"""The entry points: scraping a source into raw pages, Markdown and a manifest; extracting again; indexing; reporting."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from contextlib import nullcontext

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.html import extract_pages
from .functions.text import url_slug
from .functions.tokens import APPROXIMATE, TokenCounter
from .operators import chunking, embedding, headings, reporting, selection
from .operators.store import VersionedStore
from .sources import sinks
from .sources.documents import SourceAdapter
from .sources.fetch import ScraperScope
from .staging import stage

#: Documents and failures that a report's text lists at most.
LISTED = 1000
_NOW = "date_format(current_timestamp(), \"yyyy-MM-dd'T'HH:mm:ssXXX\")"


def _stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table that earlier runs wrote, empty if there is none."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    return spark.read.schema(schema).parquet(path) if p.getFileSystem(conf).exists(p) else spark.createDataFrame([], schema)


def _results(pages: DataFrame, key: str = "slug") -> DataFrame:
    """The key, error_type, error, title, words, markdown of fetched pages (key, url, html, error_type, error)."""
    got = extract_pages(pages.where("html is not null").select(*dict.fromkeys([key, "url"]), "html"))
    bad = F.col("error").isNotNull()
    ok = got.select(key, F.when(bad, "ExtractionError").alias("error_type"), "error", "title", "words", "markdown")
    null = F.lit(None)
    lost = pages.where("html is null").select(key, "error_type", "error", null.cast("string").alias("title"), null.cast("int").alias("words"), null.cast("string").alias("markdown"))
    return stage(ok.unionByName(lost), "extracted")


def run_scraping(
    spark: SparkSession, adapter: SourceAdapter, target: int, out: str, *, base: str, sections: tuple[str, str], share: float = 0.6,
    seed: str = "42", robots: str | None = None, agent: str = "corpusmill", dry_run: bool = False, scope: ScraperScope | None = None,
) -> dict:
    """Discovers, samples, fetches, extracts and writes; returns the counters, with ``manifest``, the path of the manifest.

    Nothing discovered, a section that isn't wanted, a forbidden address or too many failures end the run with an error;
    the last one after the manifest has been written. Addresses whose slug has Markdown are skipped. Only counts reach
    the driver. A dry run discovers and writes nothing. robots: the text of the site's rules; null allows everything. A
    ``scope`` is open for the run: it brings the rules and fetches in place of the adapter.

    Each selected row has a row in the manifest. Where addresses repeat or share a slug, each address is fetched once; the
    first row in order that succeeds writes its slug's Markdown, those behind it are skipped.
    """
    with scope or nullcontext():
        return _scrape(spark, adapter, target, out, base, sections, share, seed, scope.robots if scope else robots, scope.agent if scope else agent, dry_run, scope.pages if scope else adapter.fetch)


def _scrape(
    spark: SparkSession, adapter: SourceAdapter, target: int, out: str, base: str, sections: tuple[str, str], share: float,
    seed: str, robots: str | None, agent: str, dry_run: bool, fetch: Callable[[DataFrame], DataFrame],
) -> dict:
    start = time.monotonic()
    found = stage(adapter.discover(spark), "candidates")
    discovered = found.count()
    if not discovered:
        raise selection.RunAborted("no address was discovered in the wanted sections")
    selection.cast_section(found, sections)
    if dry_run:
        return {"discovered": discovered, "downloaded": 0, "failed": 0, "skipped": 0, "duration_seconds": time.monotonic() - start, "manifest": None}
    picked = selection.balanced_sample(found, target, first=sections[0], second=sections[1], share=share, seed=seed)
    picked = stage(picked.withColumn("slug", url_slug("url", base)), "selected")
    selection.assert_allowed(picked, selection.robots_allowed(selection.url_path("url"), selection.parse_robots(robots, agent)))

    have = _stored(spark, f"{out}/markdown", "slug string, md string").select("slug").distinct()
    todo = picked.join(have, "slug", "left_anti")
    pages = stage(fetch(todo.select("url").distinct()).dropDuplicates(["url"]), "fetched")
    results = _results(pages, "url")
    rows = todo.select("ord", "slug", "url").join(results.drop("markdown"), "url")
    first = rows.where("error_type is null").groupBy("slug").agg(F.min("ord").alias("_first"))
    tried = stage(rows.join(first, "slug", "left"), "tried")
    done = picked.join(have, "slug", "left_semi").select("ord").union(tried.where("ord > _first").select("ord"))
    docs = selection.document_status(picked, done, tried, key="ord").withColumn("scraped_at", F.expr(_NOW))
    docs = stage(docs, "documents")
    run = uuid.uuid4().hex
    last = tried.where("coalesce(ord <= _first, true)").groupBy("slug").agg(F.max_by("url", "ord").alias("url"))
    sinks.write_raw_pages(last.join(pages.where("html is not null"), "url"), f"{out}/raw/{run}", order="url")
    good = docs.where("status = 'success'").join(results.select("url", F.col("markdown").alias("body")), "url")
    sinks.markdown_files(good).write.mode("append").parquet(f"{out}/markdown")
    counted = selection.run_counters(docs).first()
    manifest = f"{out}/manifest/{run}"
    sinks.write_manifest(docs, manifest, discovered, time.monotonic() - start)
    selection.assert_fail_rate(docs)
    return {"discovered": discovered, **{k: counted[k] for k in ("downloaded", "failed", "skipped")}, "duration_seconds": time.monotonic() - start, "manifest": manifest}


def run_reprocess(spark: SparkSession, manifest: DataFrame, pages: DataFrame, out: str, *, base: str) -> dict:
    """Extracts stored pages (slug, url, html) of a manifest's documents again and writes a new manifest and Markdown.

    Documents without a page stay as they are; their number is not counted as a success or failure.
    """
    start = time.monotonic()
    old = stage(manifest.withColumn("slug", url_slug("url", base)), "old")
    wanted = pages.join(old.select("slug").distinct(), "slug", "left_semi").select("slug", "url", "html", F.lit(None).cast("string").alias("error_type"), F.lit(None).cast("string").alias("error"))
    results = _results(wanted)
    kept = old.select("slug", "ord", "scraped_at", "html_raw_path")
    docs = stage(selection.reprocess(old, results).join(kept, "slug"), "documents")
    good = docs.where("outcome = 'ok'").join(results.select("slug", F.col("markdown").alias("body")), "slug")
    run = uuid.uuid4().hex
    sinks.markdown_files(good).write.parquet(f"{out}/markdown-{run}")
    n = {r["outcome"]: r["n"] for r in docs.groupBy("outcome").agg(F.count(F.lit(1)).alias("n")).collect()}
    path = f"{out}/manifest/{run}"
    sinks.write_manifest(docs, path, old.count(), time.monotonic() - start)
    return {"downloaded": n.get("ok", 0), "failed": n.get("fail", 0), "skipped": 0, "preserved": n.get("preserved", 0), "manifest": path, "markdown": f"{out}/markdown-{run}"}


def chunks_to_index(
    docs: DataFrame, *, target: int = chunking.TARGET, overlap: int = chunking.OVERLAP, least: int = chunking.LEAST, counter: TokenCounter = APPROXIMATE,
) -> DataFrame:
    """The staged chunks of documents, which a dry run and the runs behind it can share (``index_documents``)."""
    key = ["url", "title", "section", "scraped_at", "word_count"]
    return stage(chunking.chunk_documents(docs, key=key, target=target, overlap=overlap, least=least, counter=counter), "chunks")


def index_documents(
    spark: SparkSession, docs: DataFrame, store: VersionedStore, provider: embedding.Provider, *, model: str = "text-embedding-3-small",
    dimension: int = embedding.DIMENSION, source: str = "docs", dry_run: bool = False, ask: Callable[[str], str] | None = None,
    target: int = chunking.TARGET, overlap: int = chunking.OVERLAP, least: int = chunking.LEAST, counter: TokenCounter = APPROXIMATE,
    chunks: DataFrame | None = None,
) -> dict:
    """Chunks, prices, embeds and upserts documents (url, title, section, scraped_at, word_count, body).

    A dry run, and one whose cost nobody confirms, skip all chunks and change nothing; the former reports the estimated
    cost, the latter 0. All counts and cost use one counter. ``chunks``: those of the same documents, if they are made.
    """
    start = time.monotonic()
    if chunks is None:
        chunks = chunks_to_index(docs, target=target, overlap=overlap, least=least, counter=counter)
    total = chunks.agg(F.coalesce(F.sum("token_count"), F.lit(0)), F.count(F.lit(1)), F.count_distinct("url")).first()
    cost = embedding.estimate_cost(total[0], model)
    out = {
        "docs_processed": total[2], "chunks_created": 0, "chunks_updated": 0, "chunks_deleted": 0, "chunks_skipped": total[1],
        "total_tokens": total[0], "total_cost_usd": cost,
        "chunks_per_section": {r[0]: r[1] for r in reporting.section_distribution(chunks).collect()},
        "token_stats": {k: v for k, v in reporting.token_stats(chunks).first().asDict().items() if v is not None},
    }
    if not dry_run and not embedding.cost_confirmed(cost, ask):
        out["total_cost_usd"] = 0.0
    elif not dry_run:
        made = stage(embedding.embed_texts(chunks, provider, dimension=dimension), "embedded")
        from .functions.text import chunk_metadata

        rows = made.withColumns({"doc_url": F.col("url"), "doc_title": F.coalesce("title", F.lit("")), "metadata": chunk_metadata(F.lit(source), "word_count", "scraped_at"), "pos": F.col("chunk_index")})
        out |= store.upsert(rows) | {"chunks_skipped": 0}
    return out | {"duration_seconds": time.monotonic() - start}


def write_report(spark: SparkSession, counters: dict, documents: DataFrame, markdown: DataFrame, path: str) -> str:
    """Writes the Markdown report of a run and returns it; without any document with Markdown it fails.

    documents: of a manifest; markdown: slug, md of those that have some. The listing and the failures are written whole, as
    tables beside the report (``path`` with ``_documents`` and ``_failures``); the text holds the first ``LISTED`` of each.
    """
    from .functions.text import front_matter_field, strip_front_matter

    files = markdown.join(documents.where("status <> 'failed'").select("slug").distinct(), "slug", "left_semi")
    files = stage(files.select("slug", front_matter_field("md", r"^word_count:\s*(\d+)").cast("int").alias("word_count"), front_matter_field("md", r'^title:\s*"([^"]*)"').alias("title"), strip_front_matter("md").alias("body")), "files")
    rows = documents.select("slug", "url", "section").join(files.where("word_count is not null"), "slug")
    found = headings.empty_headings(files, key="slug", body="body")
    words = reporting.word_count_stats(rows).first().asDict()
    if not words["n"]:
        raise ValueError("no document has a word count")
    listing = reporting.report_listing(rows)
    listing.write.mode("overwrite").parquet(f"{path}_documents")
    failures = documents.where("status = 'failed'")
    failures.write.mode("overwrite").parquet(f"{path}_failures")
    text = reporting.render_report(
        counters,
        reporting.status_by_section(documents).orderBy("section").collect(),
        words,
        headings.empty_heading_summary(found, rows, key="slug").first().asDict(),
        headings.top_titles(found, order=["slug", "pos"]).collect(),
        listing.where(F.col("n") <= LISTED).orderBy("n").collect(),
        failures.orderBy("url").limit(LISTED).collect(),
    )
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)
    return text
