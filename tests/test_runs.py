"""The entry points end to end, with a source and a provider of the tests' own."""

import pytest
from pyspark.sql import functions as F

from corpusmill import runs
from corpusmill.operators import embedding, selection, store
from corpusmill.sources import documents as S
from corpusmill.sources.fetch import fetch_pages

BASE = "https://d.example.org"
WORDS = " ".join(f"word{k}" for k in range(150))


class Site:
    def __init__(self, n, broken=(), short=()):
        self.n, self.broken, self.short = n, broken, short

    def discover(self, spark):
        rows = [(f"{BASE}/en/{s}/{k}", s, k) for s in ("sql", "mig") for k in range(self.n)]
        return spark.createDataFrame(rows, "url string, section string, ord long")

    def fetch(self, selected):
        broken, short = self.broken, self.short

        def get(url):
            k = int(url.rsplit("/", 1)[1])
            if k in broken:
                raise KeyError("gone")
            return f"<title>T {k}</title><body><nav>menu</nav><article><h1>Head {k}</h1><h2>Empty</h2><h2>Full</h2><p>{'few' if k in short else WORDS}</p></article></body>"

        return fetch_pages(selected, get, rate=10_000)


def scrape(spark, site, target, out, **more):
    return runs.run_scraping(spark, site, target, out, base=BASE, sections=("sql", "mig"), **more)


def test_scraping_writes_skips_and_reports(spark, tmp_path):
    out = f"file://{tmp_path}/out"
    got = scrape(spark, Site(20, short=(0,)), 10, out, robots="User-agent: *\nDisallow: /private")
    docs = S.read_manifest_documents(spark, got["manifest"])
    assert got["discovered"] == 40 and got["downloaded"] + got["failed"] == 10 and docs.count() == 10
    assert {r["section"]: r["count"] for r in docs.groupBy("section").count().collect()} == {"sql": 6, "mig": 4}
    md = spark.read.parquet(f"{out}/markdown")
    assert md.count() == got["downloaded"] and md.where("md like '%menu%'").count() == 0
    loaded = S.load_markdown(md.withColumnRenamed("md", "raw"))
    assert loaded.where("reject is null").count() == md.count()
    again = scrape(spark, Site(20), 10, out)
    assert again["skipped"] == got["downloaded"] and again["downloaded"] == got["failed"]

    docs = docs.withColumn("slug", F.regexp_replace("html_raw_path", r"\.html$", ""))
    text = runs.write_report(spark, {"downloaded": got["downloaded"]}, docs, md, f"{out}/report")
    assert text.count("\n## ") == (7 if got["failed"] else 6) and "| `Empty` |" in text and "CAUTION" in text
    with pytest.raises(ValueError):
        runs.write_report(spark, {}, docs, md.limit(0), f"{out}/report")

    pages = S.read_manifest_documents(spark, got["manifest"]).select("ord", "url")
    raw = pages.where("ord <> 1").select(F.regexp_replace("url", "^https://d.example.org/", "").alias("slug"), "url").withColumn("slug", F.replace("slug", F.lit("/"), F.lit("__")))
    redone = runs.run_reprocess(spark, S.read_manifest_documents(spark, got["manifest"]), raw.withColumn("html", F.lit(f"<article><p>{WORDS}</p></article>")), out, base=BASE)
    assert redone["preserved"] == 1 and redone["downloaded"] == 9
    assert S.read_manifest_documents(spark, redone["manifest"]).count() == 10


def test_scraping_ends_early(spark, tmp_path):
    out = f"file://{tmp_path}/out"
    assert scrape(spark, Site(5), 4, out, dry_run=True)["manifest"] is None and not (tmp_path / "out").exists()
    with pytest.raises(selection.RunAborted, match="discovered"):
        scrape(spark, Site(0), 4, out)
    with pytest.raises(selection.RunAborted, match="robots"):
        scrape(spark, Site(5), 4, out, robots="User-agent: *\nDisallow: /en/sql")
    with pytest.raises(ValueError, match="unknown section"):
        runs.run_scraping(spark, Site(5), 4, out, base=BASE, sections=("sql", "other"))
    with pytest.raises(selection.RunAborted, match="failure rate"):
        scrape(spark, Site(5, broken=range(5)), 4, out)
    assert list((tmp_path / "out/manifest").iterdir())  # written before the gate closes


def test_indexing(spark, tmp_path):
    docs = spark.createDataFrame([(f"u{k}", f"T{k}", "sql" if k % 2 else "mig", "2026-01-01T00:00:00Z", 9, f"# H{k}\n{WORDS} {k}\n## Long\n" + f"{WORDS}. " * 12) for k in range(4)], "url string, title string, section string, scraped_at string, word_count int, body string")
    s = store.VersionedStore(spark, f"file://{tmp_path}/store")
    run = lambda **more: runs.index_documents(spark, docs, s, embedding.hash_provider(8), dimension=8, **more)
    dry = run(dry_run=True)
    assert dry["chunks_skipped"] > 8 and dry["total_cost_usd"] > 0 and dry["docs_processed"] == 4 and s.read().count() == 0
    assert dry["total_cost_usd"] == pytest.approx(dry["total_tokens"] / 1e6 * 0.02) and dry["token_stats"]["max_tokens"] <= 1000
    full = run()
    assert full["chunks_created"] == dry["chunks_skipped"] == sum(full["chunks_per_section"].values()) and full["chunks_skipped"] == 0
    assert run()["chunks_updated"] == full["chunks_created"] and s.read().where("size(embedding) = 8").count() == full["chunks_created"]
    embedding.PRICES["dear"] = 1e6
    try:
        refused = run(model="dear", ask=lambda _: "no")
        assert refused["total_cost_usd"] == 0.0 and refused["chunks_skipped"] == full["chunks_created"] and refused["chunks_updated"] == 0
    finally:
        del embedding.PRICES["dear"]


class Listed(Site):
    """A site whose sitemap names addresses again, and two of one slug."""

    def discover(self, spark):
        rows = [(f"{BASE}/en/sql/{k}{end}", "sql", k) for k in range(3) for end in ("", "", "/")] + [(f"{BASE}/en/mig/7", "mig", 9)] * 2
        return spark.createDataFrame(rows, "url string, section string, ord long")

    def fetch(self, selected):
        return super().fetch(selected.withColumn("url", F.regexp_replace("url", "/$", "")).distinct()).join(selected.withColumnRenamed("url", "u"), F.expr("url = regexp_replace(u, '/$', '')")).select(F.col("u").alias("url"), "html", "error_type", "error")


@pytest.mark.parametrize("broken", [(), (1,)])
def test_repeated_addresses_and_shared_slugs(spark, tmp_path, broken, monkeypatch):
    monkeypatch.setattr(selection, "FAIL_LIMIT", 1.0)
    out = f"file://{tmp_path}/out"
    got = scrape(spark, Listed(3, broken=broken), 100, out)
    docs = S.read_manifest_documents(spark, got["manifest"]).orderBy("ord").collect()
    assert [r["ord"] for r in docs] == list(range(1, 12)) and got["discovered"] == 11
    by = {}
    for r in docs:
        by.setdefault(r["url"].rstrip("/"), []).append(r["status"])
    for url, status in by.items():
        assert status == (["failed"] * 3 if url.endswith("/1") and broken else ["success"] + ["skipped"] * (len(status) - 1))
    assert got["downloaded"] + got["failed"] + got["skipped"] == 11
    md = spark.read.parquet(f"{out}/markdown")
    assert md.count() == md.select("slug").distinct().count() == got["downloaded"] == (3 if broken else 4)
    assert spark.read.parquet(f"{out}/raw/*").count() == got["downloaded"]
    assert scrape(spark, Listed(3), 100, out)["downloaded"] == (1 if broken else 0)


def test_a_scope_brings_rules_and_fetches(spark, tmp_path):
    from contextlib import contextmanager

    from corpusmill.sources.fetch import ScraperScope

    closed = []

    @contextmanager
    def client():
        try:
            yield lambda url: "User-agent: *\nDisallow: /en/sql/1" if url.endswith("robots.txt") else f"<article><p>{WORDS}</p></article>"
        finally:
            closed.append(1)

    site = Site(1)
    site.fetch = None
    got = scrape(spark, site, 2, f"file://{tmp_path}/out", scope=ScraperScope(BASE, client, rate=10_000))
    assert got["downloaded"] == 2 and closed == [1]
    with pytest.raises(selection.RunAborted, match="robots"):
        scrape(spark, Site(5), 10, f"file://{tmp_path}/other", scope=ScraperScope(BASE, client, rate=10_000))
    assert closed == [1, 1]


def test_rules_see_a_path_of_every_address(spark):
    urls = ["https://h.org", "https://h.org?q=1", "HTTPS://h.org/a", "https://h.org/a?q#f", "http://h.org:8080/b/", "https://h.org#x", "nothing"]
    rows = spark.createDataFrame([(u,) for u in urls], "url string").select(selection.url_path("url").alias("p"), selection.robots_allowed(selection.url_path("url"), [("/", False)]).alias("ok")).collect()
    assert [r["p"] for r in rows] == ["/", "/?q=1", "/a", "/a?q", "/b/", "/", "/"] and not any(r["ok"] for r in rows)


def test_runs_over_the_same_documents_share_their_chunks(spark, monkeypatch):
    from corpusmill.operators import chunking
    from corpusmill.plans import registry

    made, chunk = [], chunking.chunk_documents
    monkeypatch.setattr(chunking, "chunk_documents", lambda *a, **b: made.append(1) or chunk(*a, **b))
    rows = sorted(registry.QUERIES["index_runs"](spark, "/root/testdata/sf0.001").collect())
    assert len(made) == 1 and rows[0]["chunks_skipped"] == rows[1]["chunks_created"] == rows[2]["chunks_updated"] > 0


def test_trigram_crcs_are_those_of_a_loop():
    import zlib

    for t in ("", "a", "ab", "abc", "abcd", "äb€c\U0001d11ed \n\x00é", "日本語のテキスト", "plain words " * 40):
        assert embedding.trigram_crcs(t).tolist() == [zlib.crc32(t[k : k + 3].encode()) for k in range(max(1, len(t) - 2))]
