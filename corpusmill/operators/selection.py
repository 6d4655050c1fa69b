"""Candidates, robots rules, quota samples, schedules and the status of each address."""

from __future__ import annotations

from functools import reduce
from urllib.robotparser import RobotFileParser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import col

#: Fixed value: highest share of failures among attempts.
FAIL_LIMIT = 0.30


class RunAborted(RuntimeError):
    """A run ends: nothing discovered, an address is forbidden, or too many failed."""


def hash_order(seed: str, c: Column | str) -> Column:
    """A reproducible shuffle: the same order on every engine."""
    return F.md5(F.concat(F.lit(seed), col(c)).cast("binary"))


def quotas(target: int, first_share: float, first: int, second: int) -> tuple[int, int]:
    """How many of two strata to take: the first by its share (half to even), the second the rest, the first what lacks."""
    a = min(round(target * first_share), first)
    b = min(target - a, second)
    return a + min(max(target - a - b, 0), first - a), b


def balanced_sample(candidates: DataFrame, target: int, *, first: str, second: str, share: float = 0.6, seed: str = "42") -> DataFrame:
    """A deterministic stratified sample of (url, section, ...) with its processing order ``ord`` from 1.

    Each stratum gives its first members in hash order (a bounded top-k, so that no stratum is sorted as a whole); the
    number of sections is two, and their counts are all that reaches the driver.
    """
    candidates = candidates.drop("ord")
    n = {r[0]: r[1] for r in candidates.where(F.col("section").isin(first, second)).groupBy("section").count().collect()}
    a, b = quotas(target, share, n.get(first, 0), n.get(second, 0))
    parts = [candidates.where(F.col("section") == s).orderBy(hash_order(seed, "url"), "url").limit(k) for s, k in ((first, a), (second, b))]
    picked = reduce(DataFrame.union, parts)
    # At most ``target`` rows are numbered.
    return picked.withColumn("_o", hash_order(seed + "-order", "url")).selectExpr("* except (_o)", "row_number() over (order by _o, url) as ord")


def parse_robots(text: str | None, agent: str) -> list[tuple[str, bool]]:
    """Rules (prefix, allowed) of a robots file for an agent, in their order: those of the first group that names it, else
    those of the group for all. A rule that disallows nothing allows all; null, no file, gives no rules."""
    parser = RobotFileParser()
    parser.parse((text or "").splitlines())
    groups = [*parser.entries, *([parser.default_entry] if parser.default_entry else [])]
    found = next((g for g in groups if g.applies_to(agent)), None)
    return [("" if r.path == "*" else r.path, r.allowance) for r in found.rulelines] if found else []


def robots_allowed(url_path: Column | str, rules: list[tuple[str, bool]]) -> Column:
    """Whether a path may be fetched: the first rule (prefix, allowed) that it starts with decides; none allows."""
    out = F.lit(True)
    for prefix, allowed in reversed(rules):
        out = F.when(col(url_path).startswith(prefix), F.lit(allowed)).otherwise(out)
    return out


def cast_section(rows: DataFrame, sections: tuple[str, ...]) -> DataFrame:
    """The rows, if all their sections are among the wanted ones."""
    if bad := rows.where(~F.coalesce(F.col("section").isin(*sections), F.lit(False))).select("section").first():
        raise ValueError(f"unknown section {bad[0]}")
    return rows


def assert_allowed(selected: DataFrame, allowed: Column, order: str = "ord") -> DataFrame:
    bad = selected.where(~allowed)
    examples = [r["url"] for r in bad.orderBy(order).limit(3).collect()]
    if examples:
        raise RunAborted(f"robots rules forbid {bad.count()} addresses, such as {', '.join(examples)}")
    return selected


def fetch_schedule(selected: DataFrame, rate: float, order: str = "ord") -> DataFrame:
    """Earliest second of each request at ``rate`` requests a second."""
    if rate <= 0:
        raise ValueError("rate must be above 0")
    return selected.withColumn("at_seconds", (F.col(order) - 1) / F.lit(float(rate)))


def url_path(url: Column | str) -> Column:
    """Path and query of an address behind its host, as robots rules see them: ``/`` where there is none."""
    rest = F.regexp_extract(col(url), r"(?i)^\s*[a-z][a-z0-9+.-]*://[^/?#]*([^#]*)", 1)
    return F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))


def document_status(selected: DataFrame, existing: DataFrame, fetched: DataFrame, *, key: str = "slug") -> DataFrame:
    """Status of each selected (slug, url, section): skipped, failed or success.

    existing: slugs that have Markdown. fetched: slug, error_type, error, title, words; an address that is absent was not
    fetched. An extraction error keeps the raw page's path, any other error has none. Where slugs repeat among the selected,
    all three tables have another ``key``, one a row.
    """
    have = existing.select(key).distinct().withColumn("_have", F.lit(True))
    rows = selected.join(have, key, "left").join(fetched.select(key, "error_type", "error", "title", "words", F.lit(True).alias("_got")), key, "left")
    raw, md = F.concat("slug", F.lit(".html")), F.concat("slug", F.lit(".md"))
    skipped, failed = F.col("_have").isNotNull(), F.col("error_type").isNotNull() | F.col("_got").isNull()
    status = F.when(skipped, "skipped").when(failed, "failed").otherwise("success")
    kept = F.when(skipped, F.when(F.col("_got").isNotNull(), raw)).when(failed, F.when(F.col("error_type") == "ExtractionError", raw)).otherwise(raw)
    why = F.when(~skipped & failed, F.concat_ws(": ", F.coalesce("error_type", F.lit("FetchError")), F.coalesce("error", F.lit("no page"))))
    ok = ~skipped & ~failed
    return rows.select(*dict.fromkeys([key, "slug"]), "url", "section", status.alias("status"), F.when(ok, F.col("title")).alias("title"), kept.alias("html_raw_path"), F.when(skipped | ok, md).alias("markdown_path"), F.when(ok, F.col("words")).otherwise(0).alias("word_count"), why.alias("error_message"))


def run_counters(documents: DataFrame) -> DataFrame:
    """One row: selected, downloaded, failed, skipped, failure rate of the attempts, and whether the gate closes."""
    c = documents.agg(F.count(F.lit(1)).alias("selected"), F.count_if(F.col("status") == "success").alias("downloaded"), F.count_if(F.col("status") == "failed").alias("failed"), F.count_if(F.col("status") == "skipped").alias("skipped"))
    tried = F.col("downloaded") + F.col("failed")
    rate = F.when(tried > 0, F.col("failed") / tried).otherwise(F.lit(0.0))
    return c.withColumn("fail_rate", rate).withColumn("aborted", rate > FAIL_LIMIT)


def assert_fail_rate(documents: DataFrame) -> None:
    r = run_counters(documents).first()
    if r["aborted"]:
        raise RunAborted(f"failure rate {r['fail_rate']:.0%} > {FAIL_LIMIT:.0%}")


def reprocess(manifest: DataFrame, pages: DataFrame) -> DataFrame:
    """A new manifest from stored pages: rows without a page stay as they are; a failed extraction has no Markdown path;
    a success keeps its time and gets a path if it had none. pages: slug, error_type, error, title, words."""
    p = pages.select("slug", F.col("error_type").alias("_et"), F.col("error").alias("_e"), F.col("title").alias("_t"), F.col("words").alias("_w"), F.lit(True).alias("_p"))
    rows = manifest.join(p, "slug", "left")
    none, bad = F.col("_p").isNull(), F.col("_et").isNotNull()
    pick = lambda old, failed, good: F.when(none, F.col(old)).when(bad, failed).otherwise(good)
    null = F.lit(None).cast("string")
    return rows.select(
        "slug", "url", "section",
        pick("status", F.lit("failed"), F.lit("success")).alias("status"),
        pick("title", null, F.col("_t")).alias("title"),
        pick("markdown_path", null, F.coalesce("markdown_path", F.concat("slug", F.lit(".md")))).alias("markdown_path"),
        pick("word_count", F.lit(0), F.col("_w")).alias("word_count"),
        pick("error_message", F.concat_ws(": ", "_et", "_e"), null).alias("error_message"),
        F.when(none, "preserved").when(bad, "fail").otherwise("ok").alias("outcome"),
    )
