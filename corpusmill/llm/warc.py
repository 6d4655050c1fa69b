"""WARC records: reading header blocks, and resolving not-modified revisits to the response that they confirm."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, stage

#: Captures of one address that a time bucket holds, before it ends with the minute.
ROWS_PER_BUCKET = 1_000

# Fixed value: the profile of a revisit that stands for a 304 response.
NOT_MODIFIED = "server-not-modified"
# Header fields of a 304 response that don't replace stored ones (hop by hop, or about the stored body).
NOT_MERGED = "connection keep-alive proxy-authenticate proxy-authorization proxy-connection te trailer transfer-encoding upgrade content-length content-encoding content-type content-range content-md5 set-cookie".split()


def canonical_url(url: Column) -> Column:
    """Host and path without scheme, ``www.``, the scheme's own port, fragment and closing slashes; query fields sorted,
    tracking fields (utm_) left out. Null stays null."""
    whole = F.regexp_replace(F.trim(url), r"#.*$", "")
    scheme = F.lower(F.regexp_extract(whole, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    bare = F.regexp_replace(whole, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, r"^([^/?]*)", 1)), r"^www\.", "")
    own = F.when(scheme == "http", ":80").when(scheme == "https", ":443")
    host = F.when(host.endswith(own), F.substring(host, F.lit(1), F.length(host) - F.length(own))).otherwise(host)
    rest = F.regexp_replace(bare, r"^[^/?]*", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^([^?]*)", 1), r"/+$", "")
    fields = F.filter(F.split(F.regexp_extract(rest, r"\?(.*)$", 1), "&"), lambda x: (x != "") & ~x.startswith("utm_"))
    query = F.array_join(F.array_sort(fields), "&")
    return F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))


def header_fields(block: Column) -> Column:
    """Array of (name, value) of a header block's lines behind the first; names in lower case, lines without colon left out."""
    every = F.split(block, "\r\n")
    lines = F.filter(F.slice(every, F.lit(2), F.greatest(F.size(every), F.lit(0))), lambda x: x.contains(":"))
    return F.transform(lines, lambda x: F.struct(F.lower(F.trim(F.substring_index(x, ":", 1))).alias("name"), F.trim(F.regexp_replace(x, r"^[^:]*:", "")).alias("value")))


def field(fields: Column, name: str) -> Column:
    """The first field of a name, or null."""
    return F.get(F.filter(fields, lambda x: x["name"] == name), 0)["value"]


def parse_records(records: DataFrame, record_col: str = "record") -> DataFrame:
    """Splits raw records (header block, HTTP header block, body) into columns; other columns stay.

    Adds warc_type, record_id, target_uri (of a revisit that names the address it refers to, that one), profile, date,
    status, http (array of name, value), body_chars. A record without a block, or a null one, has nulls there.
    """
    parts = F.split(F.col(record_col), "\r\n\r\n", 3)
    head, http = header_fields(F.get(parts, 0)), F.get(parts, 1)
    return records.select(
        *[c for c in records.columns if c != record_col],
        field(head, "warc-type").alias("warc_type"),
        field(head, "warc-record-id").alias("record_id"),
        F.coalesce(field(head, "warc-refers-to-target-uri"), field(head, "warc-target-uri")).alias("target_uri"),
        field(head, "warc-profile").alias("profile"),
        F.regexp_replace(field(head, "warc-date"), "Z$", "").try_cast("timestamp_ntz").alias("date"),
        F.nullif(F.regexp_extract(http, r"^HTTP/[0-9.]+ ([0-9]{3})", 1), F.lit("")).cast("int").alias("status"),
        header_fields(http).alias("http"),
        F.length(F.regexp_replace(F.get(parts, 2), r"\r\n\r\n$", "")).cast("long").alias("body_chars"),
    )


def merge_headers(stored: Column, fresh: Column) -> Column:
    """Stored fields with those of the 304 response that may replace them, sorted by name, as lines."""
    allowed = F.filter(fresh, lambda x: ~x["name"].isin(NOT_MERGED))
    names = F.transform(allowed, lambda x: x["name"])
    kept = F.filter(stored, lambda x: ~F.array_contains(names, x["name"]))
    return F.array_join(F.transform(F.array_sort(F.concat(kept, allowed)), lambda x: F.concat(x["name"], F.lit(": "), x["value"])), "\n")


def time_buckets(events: DataFrame, rows_per_bucket: int) -> DataFrame:
    """(canonical, _minute, _b) of the addresses with more events than a bucket holds: runs of minutes of about so many.

    Counts by minute, not events, are summed over an address, so that neither a date far off nor a hot address matters.
    """
    per = events.groupBy("canonical", "_minute").agg(F.count(F.lit(1)).alias("_n"))
    per = per.selectExpr("*", "sum(_n) over (partition by canonical) as _all", "sum(_n) over (partition by canonical order by _minute) - _n as _before")
    return per.where(F.col("_all") > rows_per_bucket).select("canonical", "_minute", F.floor(F.col("_before") / rows_per_bucket).alias("_b"))


def resolve_revisits(records: DataFrame, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """For each revisit: the latest earlier full response of its canonical address, and what it makes of it.

    records: as of ``parse_records``. An as-of join without a range condition: addresses and time buckets are windows in
    which each revisit sees the key (date and record id) of the last response before it; where there is none, the last
    key of an earlier bucket is carried over. Buckets hold about as many captures each, so that an address with a third
    of all captures is spread over many tasks. Only keys take part; headers of the response are joined by its key.

    status_out: ``other profile`` if the revisit isn't a not-modified one (its profile says so or, without a profile, its
    HTTP status is not 304), which this operator leaves alone; ``no response`` if there is no earlier response;
    ``resolved`` if the entity tags agree (weak comparison) or, where one of them is missing, the dates of change do;
    ``unverified`` if there is no validator to compare; ``mismatch`` if they differ. Only a response with an earlier date
    counts, to the microsecond; of several of one date, that with the greatest record id. Headers are merged for
    ``resolved`` and ``unverified``. WARC-Refers-To and its date are not followed: the as-of join decides.

    Defined cases: revisits with a null address or date stay without response; other record types are ignored, as are
    full responses with another status than 200; repeated rows are resolved each; of responses that share address, date
    and id, the greatest by their fields counts; blocks of any length and number of lines are read whole; an empty table
    gives an empty result. Other columns of the records are ignored. Returns revisit_id, canonical, date, response_id,
    response_date, status_out, headers, body_chars.
    """
    r = records.where("warc_type = 'revisit' or (warc_type = 'response' and status = 200)")
    own = F.when(F.col("warc_type") == "revisit", F.coalesce(F.col("profile").endswith(NOT_MODIFIED), F.col("status") == 304, F.lit(False)))
    events = r.select((F.col("warc_type") == "response").alias("full"), own.alias("_own"), "record_id", canonical_url(F.col("target_uri")).alias("canonical"), "date", F.expr("timestampdiff(microsecond, timestamp_ntz'1970-01-01 00:00:00', date)").alias("_t"), "http", "body_chars")
    events = stage(events.withColumn("_minute", F.floor(F.col("_t") / 60_000_000)), "events")
    usable = events.where("canonical is not null and _t is not null and (full or _own)")
    again = F.when(~F.col("full"), F.struct("date", "http"))
    key = F.when(F.col("full"), F.struct("_t", F.coalesce("record_id", F.lit("")).alias("_id")))
    narrow = usable.select("canonical", "_minute", "_t", "full", "record_id", again.alias("it"), key.alias("_key"))
    buckets = time_buckets(usable.select("canonical", "_minute"), rows_per_bucket)
    narrow = stage(narrow.join(buckets, ["canonical", "_minute"], "left").withColumn("_b", F.coalesce("_b", F.lit(0))).drop("_minute"), "dealt")

    ends = narrow.groupBy("canonical", "_b").agg(F.max("_key").alias("_end"))
    ends = ends.selectExpr("canonical", "_b", "last_value(_end) ignore nulls over (partition by canonical order by _b rows between unbounded preceding and 1 preceding) as _carried")
    # Of one date, revisits come first: they don't see its responses.
    seen = narrow.selectExpr("*", "last_value(_key) ignore nulls over (partition by canonical, _b order by _t, full, _key rows between unbounded preceding and 1 preceding) as _near")
    found = seen.where("not full").join(ends, ["canonical", "_b"]).withColumn("_found", F.coalesce("_near", "_carried"))
    found = found.select("record_id", "canonical", "it", F.col("_found._t").alias("_ft"), F.col("_found._id").alias("_fid"))
    full = usable.where("full").groupBy("canonical", F.col("_t").alias("_ft"), F.coalesce("record_id", F.lit("")).alias("_fid"))
    full = full.agg(F.max(F.struct("http", "body_chars", "record_id", "date")).alias("_r"))
    # Staged: the join may then split a response that many revisits found.
    found = stage(found, "found").join(stage(full, "responses"), ["canonical", "_ft", "_fid"], "left").select("record_id", "canonical", "it", "_r", F.lit(True).alias("_own"))
    alone = events.where("not full and not (_own and canonical is not null and _t is not null)").select("record_id", "canonical", again.alias("it"), F.lit(None).cast(found.schema["_r"].dataType).alias("_r"), "_own")
    both = found.union(alone)
    tag = lambda c: F.regexp_replace(field(F.col(c)["http"], "etag"), r"^W/", "")
    changed = lambda c: field(F.col(c)["http"], "last-modified")
    out = (
        F.when(~F.col("_own"), "other profile")
        .when(F.col("_r").isNull(), "no response")
        .when(tag("it").isNotNull() & tag("_r").isNotNull(), F.when(tag("it") == tag("_r"), "resolved").otherwise("mismatch"))
        .when(changed("it").isNotNull() & changed("_r").isNotNull(), F.when(changed("it") == changed("_r"), "resolved").otherwise("mismatch"))
        .otherwise("unverified")
    )
    both = both.withColumn("status_out", out)
    good = F.col("status_out").isin("resolved", "unverified")
    return both.select(
        F.col("record_id").alias("revisit_id"),
        "canonical",
        F.col("it.date").alias("date"),
        F.col("_r.record_id").alias("response_id"),
        F.col("_r.date").alias("response_date"),
        "status_out",
        F.when(good, merge_headers(F.col("_r.http"), F.col("it.http"))).alias("headers"),
        F.when(good, F.col("_r.body_chars")).alias("body_chars"),
    )


def capture_log(pages: DataFrame) -> DataFrame:
    """Raw WARC records made from ``pages``: each page's full response and one not-modified revisit of its address.

    Dates depend on page_id, so that some revisits precede every response. One in five revisits carries another entity
    tag, one in seven has only a date of change. A page without an id has records without a number.
    """
    day = lambda m: f"date_format(timestampadd(second, pmod(coalesce(page_id, 0) * {m}, 31536000), timestamp_ntz'2024-01-01 00:00:00'), \"yyyy-MM-dd'T'HH:mm:ss'Z'\")"
    profile = f"\\r\\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/{NOT_MODIFIED}"
    head = lambda kind, m: f"concat('WARC/1.1\\r\\nWARC-Type: {kind}\\r\\nWARC-Record-ID: {kind}-', coalesce(cast(page_id as string), ''), '{profile if kind == 'revisit' else ''}\\r\\nWARC-Target-URI: ', coalesce(url, ''), '\\r\\nWARC-Date: ', {day(m)}, '\\r\\n\\r\\n')"
    tag = "concat('\"', md5(coalesce(html, '')), '\"')"
    full = f"""concat({head("response", 7919)}, 'HTTP/1.1 200 OK\\r\\nETag: ', {tag}, '\\r\\nLast-Modified: day ', coalesce(pmod(page_id, 28), 0), '\\r\\nCache-Control: max-age=60\\r\\nContent-Type: text/html\\r\\nContent-Length: ', octet_length(coalesce(html, '')), '\\r\\n\\r\\n', coalesce(html, ''), '\\r\\n\\r\\n')"""
    again = f"""concat({head("revisit", 104729)}, 'HTTP/1.1 304 Not Modified\\r\\n', case when page_id % 7 = 0 then '' when page_id % 5 = 0 then 'ETag: "other"\\r\\n' else concat('ETag: W/', {tag}, '\\r\\n') end, 'Last-Modified: day ', coalesce(pmod(page_id, 28), 0), '\\r\\nCache-Control: max-age=', coalesce(pmod(page_id, 1000), 0), '\\r\\nContent-Length: 0\\r\\n\\r\\n')"""
    return pages.select(F.explode(F.array(F.expr(full), F.expr(again))).alias("record"))


def op9_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve_revisits(parse_records(capture_log(read_table(spark, sf_dir, "pages"))))


OP9_SQL = r"""
WITH a AS (SELECT page_id, html, regexp_replace(trim(coalesce(url, '')), '#.*$', '') AS w, regexp_replace(w, '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS u FROM pages),
b AS (SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(u, '^([^/?]*)', 1)), '^www\.', ''), CASE WHEN starts_with(lower(w), 'http://') THEN ':80$' WHEN starts_with(lower(w), 'https://') THEN ':443$' ELSE '$' END, '') AS host, regexp_replace(u, '^[^/?]*', '') AS rest FROM a),
c AS (SELECT *, regexp_replace(regexp_extract(rest, '^([^?]*)', 1), '/+$', '') AS path,
  array_to_string(list_sort(list_filter(string_split(regexp_extract(rest, '\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT starts_with(x, 'utm_'))), '&') AS q FROM b),
p AS (SELECT page_id, html, host || path || CASE WHEN q <> '' THEN '?' || q ELSE '' END AS canonical, '"' || md5(coalesce(html, '')) || '"' AS tag, page_id % 28 AS day,
  to_timestamp(1704067200 + page_id * 7919 % 31536000) AS full_at, to_timestamp(1704067200 + page_id * 104729 % 31536000) AS again_at FROM c),
m AS (SELECT r.page_id, r.canonical, r.tag AS own, r.day AS own_day, r.again_at, f.page_id AS f_id, f.full_at, f.tag, f.day, f.html,
  row_number() OVER (PARTITION BY r.page_id ORDER BY f.full_at DESC, 'response-' || f.page_id DESC) AS k
  FROM p r LEFT JOIN p f ON r.canonical = f.canonical AND f.full_at < r.again_at),
s AS (SELECT *, CASE WHEN f_id IS NULL THEN 'no response' WHEN page_id % 7 = 0 THEN CASE WHEN own_day = day THEN 'resolved' ELSE 'mismatch' END
  WHEN page_id % 5 = 0 THEN 'mismatch' WHEN own = tag THEN 'resolved' ELSE 'mismatch' END AS status_out FROM m WHERE k = 1)
SELECT 'revisit-' || page_id AS revisit_id, canonical, again_at::TIMESTAMP AS date, 'response-' || f_id AS response_id, full_at::TIMESTAMP AS response_date, status_out,
  CASE WHEN status_out = 'resolved' THEN 'cache-control: max-age=' || page_id % 1000 || chr(10) || 'content-length: ' || strlen(coalesce(html, '')) || chr(10) || 'content-type: text/html' || chr(10)
    || 'etag: ' || CASE WHEN page_id % 7 = 0 THEN tag ELSE 'W/' || own END || chr(10) || 'last-modified: day ' || own_day END AS headers,
  CASE WHEN status_out = 'resolved' THEN length(coalesce(html, '')) END AS body_chars
FROM s
"""
