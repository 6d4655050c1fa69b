"""Inputs of the registered queries, derived by Spark from the given tables, and the same as SQL.

``documents`` has no Markdown headings and ``pages`` no code wrappers; headings, front matter and stores are made from
what the tables hold by fixed rules, over all rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import TOKEN, WORD, WS, approx_tokens, classify, front_matter, word_count
from ..operators.chunking import OVERLAP, SEPARATORS, TARGET, chunk_documents

RULES = [("/en/", "en"), ("/fr/", "fr"), ("/de/", "de"), ("/es/", "es")]
BASE = "https:/"
MODEL = "text-embedding-3-small"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", "url", classify("url", RULES).alias("section")).where("section is not null")


CANDIDATES = """c AS (SELECT * FROM (SELECT page_id, url, CASE WHEN contains(url, '/en/') THEN 'en' WHEN contains(url, '/fr/') THEN 'fr'
  WHEN contains(url, '/de/') THEN 'de' WHEN contains(url, '/es/') THEN 'es' END AS section FROM pages) WHERE section IS NOT NULL)"""


def markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with headings of three levels: every fourth line, with a blank line behind every second one."""
    line = "case when p % 4 = 0 then concat(repeat('#', cast(1 + (doc_id + p) % 3 as int)), ' H', p % 8) when p % 8 = 1 then '' else x end"
    body = F.expr(f"array_join(transform(split(text, '\\n'), (x, p) -> {line}), '\\n')")
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source", body.alias("body"))


BODIES = """b AS (SELECT doc_id, lang, source, array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: CASE WHEN (i - 1) % 4 = 0
  THEN repeat('#', 1 + (doc_id + i - 1) % 3) || ' H' || (i - 1) % 8 WHEN (i - 1) % 8 = 1 THEN '' ELSE x END), chr(10)) AS body FROM documents)"""


def outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with headings of five levels, some of them empty."""
    b = "cast(floor((p + 2) / 4) as int)"
    line = f"case when p % 4 = 2 then concat(repeat('#', cast(1 + ({b} * 7 + doc_id) % 5 as int)), ' H', p % 8) when p % 2 = 1 and (doc_id + {b}) % 2 = 0 then '' when p % 4 = 0 and (doc_id + {b}) % 2 = 0 then '' else x end"
    body = F.expr(f"array_join(transform(split(text, '\\n'), (x, p) -> {line}), '\\n')")
    return table(spark, sf_dir, "documents").select("doc_id", "lang", body.alias("body"))


OUTLINES = """o AS (SELECT doc_id, lang, array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: CASE WHEN (i - 1) % 4 = 2
  THEN repeat('#', 1 + ((i + 1) // 4 * 7 + doc_id) % 5) || ' H' || (i - 1) % 8 WHEN (i - 1) % 2 = 1 AND (doc_id + (i + 1) // 4) % 2 = 0 THEN ''
  WHEN (i - 1) % 4 = 0 AND (doc_id + (i + 1) // 4) % 2 = 0 THEN '' ELSE x END), chr(10)) AS body FROM documents)"""


def sql_tokens(x: str) -> str:
    return f"len(regexp_extract_all({x}, '{TOKEN}'))"


def sql_words(x: str) -> str:
    return f"len(regexp_extract_all({x}, '{WORD}+'))"


def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


_SECTIONS = """,
l AS (SELECT doc_id, lang, source, unnest(range(len(a))) AS p, unnest(a) AS line FROM (SELECT *, string_split(body, chr(10)) AS a FROM b)),
v AS (SELECT *, length(regexp_extract(line, '^(#{1,3})( |$)', 1)) AS lvl FROM l),
w AS (SELECT *, sum(CASE WHEN lvl > 0 OR p = 0 THEN 1 ELSE 0 END) OVER d - 1 AS pos,
  last_value(CASE WHEN lvl = 1 THEN p END IGNORE NULLS) OVER d AS p1, last_value(CASE WHEN lvl = 2 THEN p END IGNORE NULLS) OVER d AS p2, last_value(CASE WHEN lvl = 3 THEN p END IGNORE NULLS) OVER d AS p3,
  last_value(CASE WHEN lvl = 1 THEN trim(substr(line, 2)) END IGNORE NULLS) OVER d AS h1, last_value(CASE WHEN lvl = 2 THEN trim(substr(line, 3)) END IGNORE NULLS) OVER d AS h2, last_value(CASE WHEN lvl = 3 THEN trim(substr(line, 4)) END IGNORE NULLS) OVER d AS h3
  FROM v WINDOW d AS (PARTITION BY doc_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
q AS (SELECT *, CASE WHEN p2 > coalesce(p1, -1) THEN h2 END AS k2, CASE WHEN p3 > coalesce(p1, -1) AND p3 > coalesce(p2, -1) THEN h3 END AS k3 FROM w),
s AS (SELECT doc_id, lang, source, CAST(pos AS INT) AS pos, string_agg(line, chr(10) ORDER BY p) AS content,
  nullif(array_to_string(list_filter([first(h1 ORDER BY p), first(k2 ORDER BY p), first(k3 ORDER BY p)], lambda x: x IS NOT NULL AND x <> ''), ' > '), '') AS heading_path FROM q GROUP BY ALL)"""

SECTIONS = BODIES + _SECTIONS


def sql_split(target: int, overlap: int, out: str) -> str:
    """CTEs that split the sections s over the budget as ``recursive_split`` does, separator by separator: (doc_id, pos,
    ord, content), pieces of a section in the order of the lists ord. Token counts add up at separators, so that running
    sums stand for the window; a fold over the parts keeps where the window begins and the pieces so far."""
    piece = "STRUCT(a BIGINT, b BIGINT, big BOOLEAN)[]"
    sql, done = [f"r0 AS (SELECT doc_id, pos, []::BIGINT[] AS ord, content AS text, {sql_tokens('content')} AS n FROM s)"], [f"SELECT doc_id, pos, ord, text AS content FROM r0 WHERE n <= {target}"]
    for k, separator in enumerate(SEPARATORS):
        sep = " || ".join("chr(10)" if c == "\n" else f"'{c}'" for c in separator)
        flush = "CASE WHEN acc.w < x.i THEN [{a: acc.w, b: x.i - 1, big: false}] ELSE [] END"
        next_w = f"list_filter(range(acc.w, x.i + 1), lambda j: q[x.i] - q[j] <= least({overlap}, {target} - c[x.i]))[1]"
        sql += [
            f"p{k} AS (SELECT *, list_filter(list_transform(string_split(text, {sep}), lambda p, i: CASE WHEN i = 1 THEN p ELSE {sep} || p END), lambda p: p <> '') AS parts FROM r{k} WHERE n > {target} AND contains(text, {sep}))",
            f"c{k} AS (SELECT *, list_transform(parts, lambda p: {sql_tokens('p')}) AS c FROM p{k})",
            f"q{k} AS (SELECT *, list_transform(range(0, len(c) + 1), lambda i: coalesce(list_sum(c[1:i]), 0)) AS q FROM c{k})",
            f"""z{k} AS (SELECT *, list_reduce(list_transform(range(1, len(c) + 1), lambda i: {{i: i, w: 0::BIGINT, o: []::{piece}}}), lambda acc, x:
  CASE WHEN c[x.i] > {target} THEN {{i: x.i, w: x.i + 1, o: acc.o || {flush} || [{{a: x.i, b: x.i, big: true}}]}}
  WHEN acc.w < x.i AND q[x.i] - q[acc.w] + c[x.i] > {target} THEN {{i: x.i, w: {next_w}, o: acc.o || {flush}}} ELSE {{i: x.i, w: acc.w, o: acc.o}} END,
  {{i: 0::BIGINT, w: 1::BIGINT, o: []::{piece}}}) AS f FROM q{k})""",
            f"o{k} AS (SELECT doc_id, pos, ord, parts, c, unnest(f.o || CASE WHEN f.w <= len(c) THEN [{{a: f.w, b: len(c), big: false}}] ELSE [] END) AS o, generate_subscripts(f.o || CASE WHEN f.w <= len(c) THEN [{{a: f.w, b: len(c), big: false}}] ELSE [] END, 1) AS k FROM z{k})",
            f"r{k + 1} AS (SELECT doc_id, pos, ord || [k::BIGINT] AS ord, parts[o.a] AS text, c[o.a] AS n FROM o{k} WHERE o.big UNION ALL SELECT doc_id, pos, ord, text, n FROM r{k} WHERE n > {target} AND NOT contains(text, {sep}))",
        ]
        done.append(f"SELECT * FROM (SELECT doc_id, pos, ord || [k::BIGINT] AS ord, {sql_strip("array_to_string(parts[o.a:o.b], '')")} AS content FROM o{k} WHERE NOT o.big) WHERE content <> ''")
    done.append(f"SELECT doc_id, pos, ord, text FROM r{len(SEPARATORS)}")
    return ", ".join([*sql, f"{out} AS ({' UNION ALL '.join(done)})"])


_MERGED = f""",
{sql_split(TARGET, OVERLAP, "w0")},
f AS (SELECT s.doc_id, lang, source, s.pos, w0.ord, {sql_strip("w0.content")} AS content, heading_path FROM w0 JOIN s ON w0.doc_id = s.doc_id AND w0.pos = s.pos),
g AS (SELECT *, {sql_tokens("content")} AS t, row_number() OVER (PARTITION BY doc_id ORDER BY pos, ord) AS k FROM f WHERE content <> ''),
i AS (SELECT *, sum(CASE WHEN k = 1 OR t >= 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY k) AS grp FROM g),
m AS (SELECT doc_id, lang, source, grp, string_agg(content, chr(10) || chr(10) ORDER BY k) AS content, first(heading_path ORDER BY k) AS heading_path FROM i GROUP BY ALL)"""

MERGED = SECTIONS + _MERGED

_CHUNKS = f""",
n AS (SELECT *, {sql_tokens("content")} AS t, count(*) OVER (PARTITION BY doc_id) AS n FROM m),
z AS (SELECT *, CASE WHEN grp = 1 AND n > 1 AND max(CASE WHEN grp = 1 THEN t END) OVER (PARTITION BY doc_id) < 50 THEN 2 ELSE grp END AS g2 FROM n),
y AS (SELECT doc_id, lang, source, g2, string_agg(content, chr(10) || chr(10) ORDER BY grp) AS content, last(heading_path ORDER BY grp) AS heading_path FROM z GROUP BY ALL),
k AS (SELECT doc_id, lang, source, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY g2) - 1 AS INT) AS chunk_index, content, heading_path, CAST({sql_tokens("content")} AS INT) AS token_count FROM y)"""

CHUNKS = MERGED + _CHUNKS


def sql_chunks(bodies: str) -> str:
    """CTEs up to the chunks k of other bodies b (doc_id, lang, source, body)."""
    return bodies + _SECTIONS + _MERGED + _CHUNKS


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_documents(markdown(spark, sf_dir), key=["doc_id", "lang", "source"])


def documents_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of a run: skipped, failed and successful ones by rule, with a word count from their text."""
    # (The explode counts a text's words once, whatever reads or filters them.)
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", F.explode(F.array(word_count("text"))).alias("n"))
    n = F.col("n")
    status = F.when(F.col("doc_id") % 10 == 0, "skipped").when(n < 100, "failed").otherwise("success")
    url = F.concat(F.lit("https://docs.example.org/en/"), F.col("lang"), F.lit("/d"), F.col("doc_id"))
    return d.select("doc_id", url.alias("url"), F.col("lang").alias("section"), F.concat(F.lit("T | "), F.col("doc_id")).alias("title"), status.alias("status"), n.alias("word_count"))


FOUND = f"""u AS (SELECT doc_id, 'https://docs.example.org/en/' || lang || '/d' || doc_id AS url, lang AS section, 'T | ' || doc_id AS title,
  CASE WHEN doc_id % 10 = 0 THEN 'skipped' WHEN n < 100 THEN 'failed' ELSE 'success' END AS status, CAST(n AS INT) AS word_count FROM (SELECT *, {sql_words("text")} AS n FROM documents))"""


def raw_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markdown files of documents; some titles break their header, some files have none."""
    # (As above; a filter on what is read from the file isn't moved below the explode.)
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "text", F.explode(F.array(word_count("text"))).alias("n"))
    title = F.when(F.col("doc_id") % 9 == 0, "a --- b").otherwise(F.concat(F.lit('T "'), F.col("doc_id"), F.lit('"')))
    header = front_matter(F.concat(F.lit("https://x.example.org/"), F.col("doc_id")), title, F.col("lang"), F.lit("2026-01-02T03:04:05+00:00"), "n")
    raw = F.when(F.col("doc_id") % 11 == 0, F.col("text")).otherwise(F.concat(header, F.col("text"), F.lit("\n")))
    return d.select("doc_id", raw.alias("raw"))


def stored_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store before a run: documents' chunks 0 to 2 by rule, for nine in ten documents."""
    d = table(spark, sf_dir, "documents").where("doc_id % 10 <> 3").select("doc_id", "lang", F.explode(F.sequence(F.lit(0), F.expr("cast(doc_id % 3 as int)"))).alias("chunk_index"))
    return d.select((F.col("doc_id") * 3 + F.col("chunk_index")).alias("id"), F.concat(F.lit("d"), F.col("doc_id")).alias("doc_url"), "chunk_index", F.lit("old").alias("doc_title"), F.col("lang").alias("section"), F.lit(None).cast("string").alias("heading_path"), F.lit("old").alias("content"), F.array().cast("array<float>").alias("embedding"), F.lit(1).alias("token_count"), F.lit("{}").alias("metadata"), F.expr("timestamp'2026-01-01 00:00:00'").alias("created_at"))


def incoming_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run's chunks: two for documents whose id isn't divisible by 4; those divisible by 5 send chunk 0 twice."""
    d = table(spark, sf_dir, "documents").where("doc_id % 4 <> 0").select("doc_id", "lang", "text", F.posexplode(F.expr("case when doc_id % 5 = 0 then array(0, 1, 0) else array(0, 1) end")).alias("pos", "chunk_index"))
    return d.select(F.concat(F.lit("d"), F.col("doc_id")).alias("doc_url"), "chunk_index", F.lit("new").alias("doc_title"), F.col("lang").alias("section"), F.lit("H").alias("heading_path"), F.concat("text", F.lit("-"), F.col("pos")).alias("content"), F.array().cast("array<float>").alias("embedding"), approx_tokens("text").alias("token_count"), F.lit("{}").alias("metadata"), "pos")


STORE = f"""e AS (SELECT doc_id * 3 + i AS id, 'd' || doc_id AS doc_url, CAST(i AS INT) AS chunk_index, lang AS section, 'old' AS content, 1 AS token_count FROM (SELECT *, unnest(range(doc_id % 3 + 1)) AS i FROM documents WHERE doc_id % 10 <> 3)),
r AS (SELECT 'd' || doc_id AS doc_url, unnest(a) AS chunk_index, unnest(range(len(a))) AS pos, lang AS section, text FROM (SELECT *, CASE WHEN doc_id % 5 = 0 THEN [0, 1, 0] ELSE [0, 1] END AS a FROM documents WHERE doc_id % 4 <> 0)),
t AS (SELECT doc_url, chunk_index, arg_max(section, pos) AS section, arg_max(text || '-' || pos, pos) AS content, CAST(max({sql_tokens("text")}) AS INT) AS token_count, count(*) AS times FROM r GROUP BY ALL),
x AS (SELECT coalesce(e.doc_url, t.doc_url) AS doc_url, coalesce(e.chunk_index, t.chunk_index) AS chunk_index, e.id, coalesce(t.section, e.section) AS section, coalesce(t.content, e.content) AS content, coalesce(t.token_count, e.token_count) AS token_count,
  CASE WHEN e.id IS NULL THEN 'created' WHEN t.times IS NOT NULL THEN 'updated' ELSE 'kept' END AS action, coalesce(t.times, 0) AS times FROM e FULL JOIN t ON e.doc_url = t.doc_url AND e.chunk_index = t.chunk_index),
h AS (SELECT x.*, coalesce(chunk_index >= q.n, false) AS orphan FROM x LEFT JOIN (SELECT doc_url, count(*) AS n FROM r GROUP BY 1) q USING (doc_url))"""

