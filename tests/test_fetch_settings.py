from contextlib import contextmanager

import pytest

from corpusmill.settings import Settings
from corpusmill.sources.fetch import FetchError, ScraperScope, fetch_one, fetch_pages


def test_settings():
    assert Settings.from_env({"CORPUSMILL_TARGET_TOKENS": "500", "OTHER": "x"}).target_tokens == 500
    with pytest.raises(ValueError):
        Settings.from_env({"CORPUSMILL_RATE_PER_SECOND": "0"})


def test_retries():
    waits, calls = [], []

    def flaky(url):
        calls.append(url)
        if len(calls) < 3:
            raise FetchError("503")
        return "page"

    assert fetch_one(flaky, "u", waits.append) == "page" and waits == [2.0, 4.0]
    with pytest.raises(FetchError):
        fetch_one(lambda u: (_ for _ in ()).throw(FetchError("404")), "u", waits.append)


def test_failures_are_rows(spark):
    def fetch(url):
        if url == "bad":
            raise KeyError("no")
        return f"<p>{url}"

    out = {r["url"]: r for r in fetch_pages(spark.createDataFrame([("a",), ("bad",)], "url string"), fetch, rate=1000).collect()}
    assert out["a"]["html"] == "<p>a" and out["bad"]["error_type"] == "KeyError"
    with pytest.raises(ValueError):
        fetch_pages(spark.createDataFrame([("a",)], "url string"), fetch, rate=0)


def _site(url):
    if url.endswith("/none/robots.txt"):
        raise FetchError("404")
    return "User-agent: *\nDisallow: /private" if url.endswith("/robots.txt") else f"<p>{url}"


def test_scope_opens_loads_rules_and_closes(spark):
    seen = []

    @contextmanager
    def client():
        seen.append("open")
        yield _site
        seen.append("closed")

    urls = spark.createDataFrame([("/a",), ("/private/b",)], "url string")
    with ScraperScope("https://x.example.org/", client, rate=1000) as scope:
        assert scope.base == "https://x.example.org" and seen == ["open"]
        assert [r[0] for r in scope.pages(urls.where(scope.allowed("url"))).select("html").collect()] == ["<p>/a"]
    assert seen == ["open", "closed"]
    with pytest.raises(RuntimeError):
        scope.pages(urls)
    with ScraperScope("https://x.example.org/none", client) as scope:
        assert urls.where(scope.allowed("url")).count() == 2
