"""Readers: sitemaps, Markdown documents with front matter, manifests, stored pages; and the adapter protocol."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import classify, front_matter_field, strip


class SourceAdapter(Protocol):
    """What a new source provides: candidate addresses (url, section, ord), and pages (url, html) for addresses."""

    def discover(self, spark: SparkSession) -> DataFrame: ...

    def fetch(self, selected: DataFrame) -> DataFrame: ...


_LOCS = "url array<struct<loc:string>>, sitemap array<struct<loc:string>>, _corrupt_record string"


def parse_sitemaps(sitemaps: DataFrame, xml: str = "xml") -> DataFrame:
    """One row an entry: is_index, loc, ord, with the other columns. Repeats and order stay, blank entries go, and so do
    texts that are no well-formed XML: they end neither the job nor the run."""
    parsed = F.from_xml(F.regexp_replace(F.col(xml), r"(?s)^\s+", ""), _LOCS, {"mode": "PERMISSIVE", "ignoreNamespace": "true"})
    is_index = F.col(xml).rlike(r"(?s)^\s*(<\?xml.*?\?>)?\s*(<!--.*?-->\s*)*<([A-Za-z0-9]+:)?sitemapindex[\s>]")
    keep = [c for c in sitemaps.columns if c != xml]
    rows = sitemaps.select(*keep, is_index.alias("is_index"), parsed.alias("_x")).where("_x is not null and _x._corrupt_record is null")
    rows = rows.select(*keep, "is_index", F.posexplode(F.expr("case when is_index then _x.sitemap.loc else _x.url.loc end")).alias("ord", "loc"))
    return rows.withColumn("loc", strip("loc")).where("loc <> ''")


def discover(root: DataFrame, children: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """Classified addresses of a root sitemap (column xml); an index is followed one level deep.

    children: loc, xml; a sub-sitemap that could not be fetched is absent there or has null, and is skipped. Repeats stay.
    """
    top = parse_sitemaps(root.select("xml"))
    direct = top.where("not is_index").select(F.lit(-1).alias("_top"), "ord", F.col("loc").alias("url"))
    below = top.where("is_index").select(F.col("ord").alias("_top"), "loc").join(children.where("xml is not null"), "loc")
    nested = parse_sitemaps(below.select("_top", "xml")).select("_top", "ord", F.col("loc").alias("url"))
    every = direct.union(nested).withColumn("section", classify("url", rules)).where("section is not null")
    return every.select("url", "section", F.struct("_top", "ord").alias("ord"))


def load_markdown(files: DataFrame, raw: str = "raw") -> DataFrame:
    """Typed front matter and body of Markdown files, with ``reject`` for those that break the contract (null: good).

    The header is what lies between the first two ``---`` anywhere; all five fields are required; the body loses its
    leading line ends only.
    """
    # (The outer explode cuts a file once: a filter on what follows cannot be moved below it, where it would cut again.)
    files, parts = files.select("*", F.explode_outer(F.array(F.split(F.col(raw), "---", 3))).alias("_parts")), F.col("_parts")
    head = F.get(parts, F.lit(1))
    text = lambda name: F.regexp_replace(front_matter_field(head, rf'^{name}:[ \t]*(.*?)[ \t\r]*$'), r'^"(.*)"$', "$1")
    rows = files.withColumns({
        "url": text("url"), "title": text("title"), "section": text("section"),
        "scraped_at": text("scraped_at").try_cast("timestamp"), "word_count": text("word_count").try_cast("int"),
        "body": F.regexp_replace(F.get(parts, F.lit(2)), r"^\n+", ""),
    })
    missing = F.filter(F.array(*[F.when(F.col(c).isNull(), c) for c in ("url", "title", "section", "scraped_at", "word_count")]), lambda x: x.isNotNull())
    reject = F.when(F.col(raw).isNull() | ~F.col(raw).startswith("---"), "no front matter").when(F.size(parts) < 3, "front matter is not closed").when(F.size(missing) > 0, F.concat(F.lit("missing or mistyped: "), F.array_join(missing, ", ")))
    return rows.withColumn("reject", reject).drop(raw, "_parts")


def good_documents(loaded: DataFrame, mode: str = "strict") -> DataFrame:
    """Documents without a reject reason; in strict mode a bad one ends the run."""
    if mode == "strict" and (bad := loaded.where("reject is not null").select("reject").first()):
        raise ValueError(f"bad document: {bad[0]}")
    return loaded.where("reject is null").drop("reject")


def read_markdown_folder(spark: SparkSession, path: str) -> DataFrame:
    """Markdown files in path order; none is an error."""
    files = spark.read.text(path, wholetext=True, pathGlobFilter="*.md").select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("raw"))
    if files.isEmpty():
        raise FileNotFoundError(f"no Markdown files in {path}")
    return files


def pilot(files: DataFrame, n: int = 5, seed: str = "42", path: str = "path") -> DataFrame:
    """A few files by hash order, in path order: a bounded top-k."""
    return files.orderBy(F.md5(F.concat(F.lit(seed), F.col(path)).cast("binary")), path).limit(n).orderBy(path)


MANIFEST = "total_discovered int, total_downloaded int, total_failed int, total_skipped int, duration_seconds double, documents array<struct<url:string,title:string,section:string,html_raw_path:string,markdown_path:string,scraped_at:string,word_count:int,status:string,error_message:string>>"


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).json(path, multiLine=True)


def read_manifest_documents(spark: SparkSession, path: str) -> DataFrame:
    """Documents of a manifest that ``sinks.write_manifest`` wrote, with their place ``ord``."""
    fields = MANIFEST.split("array<struct<")[1].removesuffix(">>").replace(":", " ")
    return spark.read.schema(f"ord int, {fields}").json(f"{path}/documents")


def manifest_documents(manifest: DataFrame) -> DataFrame:
    return manifest.select(F.posexplode("documents").alias("ord", "d")).select("ord", "d.*")
