"""Fetching addresses by a function that the caller hands in, with retries and a rate that partitions share."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable, Iterator
from contextlib import AbstractContextManager

import pandas as pd
from pyspark.sql import Column, DataFrame

from ..operators.selection import parse_robots, robots_allowed

log = logging.getLogger(__name__)

# Attempts and waits of the polite client.
ATTEMPTS, LEAST_WAIT, MOST_WAIT = 3, 2.0, 10.0


class FetchError(RuntimeError):
    """What a fetcher raises for any response that is not a page."""


def fetch_one(fetch: Callable[[str], str], url: str, sleep: Callable[[float], None] = time.sleep) -> str:
    for k in range(ATTEMPTS):
        try:
            return fetch(url)
        except FetchError:
            if k + 1 == ATTEMPTS:
                raise
            sleep(min(MOST_WAIT, LEAST_WAIT * 2**k))
    raise AssertionError


def fetch_pages(selected: DataFrame, fetch: Callable[[str], str], *, rate: float = 5.0, partitions: int = 1) -> DataFrame:
    """(url, html, error_type, error) of each selected address; a failure is a row, not the end of the run.

    Each of the partitions keeps its share of the rate, attempts again included, so that all together keep it.
    """
    if rate <= 0:
        raise ValueError("rate must be above 0")
    gap = partitions / rate

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = 0.0

        def paced(url: str) -> str:
            nonlocal last
            time.sleep(max(0.0, last + gap - time.monotonic()))
            last = time.monotonic()
            return fetch(url)

        for pdf in batches:
            rows = []
            for url in pdf["url"]:
                try:
                    rows.append((url, fetch_one(paced, url), None, None))
                except Exception as e:  # noqa: BLE001  any error of a fetcher marks its row
                    rows.append((url, None, type(e).__name__, str(e)))
            yield pd.DataFrame(rows, columns=["url", "html", "error_type", "error"])

    return selected.select("url").repartition(partitions).mapInPandas(run, "url string, html string, error_type string, error string")


class ScraperScope:
    """A source while it is open: ``with ScraperScope(base, client) as s: s.pages(selected)``.

    ``client`` opens what holds connections and gives a fetcher, which tasks must be able to unpickle. On entry the site's
    robots rules are loaded; where there are none to be had, all is allowed. On exit the client is closed.
    """

    def __init__(self, base: str, client: Callable[[], AbstractContextManager[Callable[[str], str]]], *, agent: str = "corpusmill", rate: float = 5.0, partitions: int = 1):
        self.base, self.agent, self.rate, self.partitions = base.rstrip("/"), agent, rate, partitions
        self._client, self._held, self._fetch, self.robots = client, None, None, None

    def __enter__(self) -> ScraperScope:
        self._held = self._client()
        self._fetch = self._held.__enter__()
        try:
            self.robots = self._fetch(f"{self.base}/robots.txt")
        except FetchError as e:
            log.warning("no robots rules (%s): all is allowed", e)
        return self

    def __exit__(self, *error: object) -> None:
        held, self._held, self._fetch = self._held, None, None
        held.__exit__(*error)

    def allowed(self, url_path: Column | str) -> Column:
        return robots_allowed(url_path, parse_robots(self.robots, self.agent))

    def pages(self, selected: DataFrame) -> DataFrame:
        """As of ``fetch_pages``; to be written while the scope is open."""
        if self._fetch is None:
            raise RuntimeError("the scope is not open")
        return fetch_pages(selected, self._fetch, rate=self.rate, partitions=self.partitions)
