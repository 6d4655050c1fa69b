"""Chunking, headings, selection, store, embedding, reporting, search and streaming."""

import math
import random

import pytest
import regex
from pyspark.sql import functions as F

from corpusmill.functions.text import TOKEN, similarity, trigrams
from corpusmill.functions.tokens import vocabulary_counter
from corpusmill.operators import chunking, embedding, headings, reporting, retrieval, selection, store
from corpusmill.streaming import ingest


def count(t):
    return len(regex.findall(TOKEN, t))


def fold(body, least, split=lambda t: [t]):
    """A loop over lines with a stack of headings, then both merges."""
    sections, stack, lines = [], {}, []
    for line in body.split("\n"):
        m = regex.match(r"(#{1,3})( |$)", line)
        if m:
            if lines:
                sections.append(("\n".join(lines), path))  # noqa: F821
            level = len(m[1])
            stack = {k: v for k, v in stack.items() if k < level} | {level: line[level:].strip(" ")}
            lines = []
        path = " > ".join(v for _, v in sorted(stack.items()) if v) or None
        lines.append(line)
    sections.append(("\n".join(lines), path))
    out = []
    for text, path in ((piece.strip(), p) for t, p in sections for piece in split(t)):
        if text and out and count(text) < least:
            out[-1] = (f"{out[-1][0]}\n\n{text}", out[-1][1])
        elif text:
            out.append((text, path))
    if len(out) > 1 and count(out[0][0]) < least:
        out[:2] = [(f"{out[0][0]}\n\n{out[1][0]}", out[1][1])]
    return out


def test_chunks_equal_a_loop(spark):
    rng, bodies = random.Random(5), []
    for _ in range(120):
        bodies.append("\n".join(rng.choice(["", "# A", "## B", "### C", "#### d", "##", "x y z", "one two three four five six"]) for _ in range(rng.randint(1, 25))))
    docs = spark.createDataFrame(list(enumerate(bodies)), "doc_url long, body string")
    got = {}
    for r in chunking.chunk_documents(docs, key=["doc_url"], least=6).orderBy("doc_url", "chunk_index").collect():
        got.setdefault(r["doc_url"], []).append((r["content"], r["heading_path"]))
        assert r["chunk_index"] == len(got[r["doc_url"]]) - 1 and r["token_count"] == count(r["content"])
    for k, b in enumerate(bodies):
        assert got.get(k, []) == fold(b, 6), b


def test_a_vocabulary_file_counts_everywhere(spark):
    import public_tokenizers

    counter = vocabulary_counter(public_tokenizers.path("byte_bpe_50k.json"))
    text = "# Big\n\n" + "\n\n".join(f"Unquestionably{k} incomprehensible, isn't it {k}?" for k in range(40))
    docs = spark.createDataFrame([("u", text), ("v", "short"), ("w", "")], "doc_url string, body string")
    out = chunking.chunk_documents(docs, key=["doc_url"], target=100, overlap=20, least=5, counter=counter).collect()
    assert all(r["token_count"] == counter.count(r["content"]) <= 100 for r in out) and {r["doc_url"] for r in out} == {"u", "v"}
    assert sum(r["doc_url"] == "u" for r in out) > 6
    assert [r["n"] for r in docs.select(counter.column("body").alias("n")).collect()] == [counter.count(t) for t in (text, "short", "")]


def test_chunks_of_documents_equal_a_loop_with_splitting(spark):
    """Default budgets scaled down, so that many sections are split; pieces come from the plain recursion."""
    rng, bodies = random.Random(8), []
    for _ in range(60):
        bodies.append("\n".join(rng.choice(["", "# A", "## B", " ".join(f"w{rng.randint(0, 9)}" + rng.choice(["", ". b", "."]) for _ in range(rng.randint(1, 60)))]) for _ in range(rng.randint(1, 12))))
    docs = spark.createDataFrame(list(enumerate(bodies)), "doc_url long, body string")
    got = {}
    for r in chunking.chunk_documents(docs, key=["doc_url"], target=30, overlap=8, least=6).orderBy("doc_url", "chunk_index").collect():
        got.setdefault(r["doc_url"], []).append((r["content"], r["heading_path"]))
    for k, b in enumerate(bodies):
        assert got.get(k, []) == fold(b, 6, lambda t: chunking.recursive_split(t, 30, 8, count)), b


def test_oversized_sections(spark):
    text = "# Big\n\n" + "\n\n".join(f"Paragraph {k} has some words in it. And a second sentence." for k in range(60))
    docs = spark.createDataFrame([("u", text)], "doc_url string, body string")
    for splitter in ("recursive", "windows"):
        out = chunking.chunk_documents(docs, key=["doc_url"], target=200, overlap=40, splitter=splitter).orderBy("chunk_index").collect()
        assert len(out) > 1 and [r["chunk_index"] for r in out] == list(range(len(out))) and all(r["token_count"] <= 300 for r in out)
    pieces = chunking.recursive_split(text, 200, 40, count)
    assert all(count(p) <= 200 for p in pieces) and all(any(w in "".join(pieces) for w in (f"Paragraph {k} ",)) for k in range(60))
    assert chunking.recursive_split("x" * 5000, 1, 0, lambda t: len(t)) == ["x" * 5000]


def test_empty_headings(spark):
    body = "# t\n\n## A\n\n## B\ntext\n## P\n### C\n\n## D\n# h1\n## last"
    docs = spark.createDataFrame([(1, body), (2, ""), (3, "## only")], "k int, body string")
    found = headings.empty_headings(docs, key="k", body="body")
    assert [(r["title"], r["level"]) for r in found.orderBy("pos").collect()] == [("A", 2), ("C", 3)]
    assert {r["title"] for r in headings.empty_headings(docs, key="k", body="body", naive=True).collect()} == {"A", "C", "P"}
    s = headings.empty_heading_summary(found, docs, key="k").first()
    assert s["docs_with_empty"] == 1 and s["empty_total"] == 2 and s["severity"] == "CAUTION"
    assert headings.empty_heading_summary(found.limit(0), docs.limit(0), key="k").first()["empty_pct"] == 0.0


def test_quotas():
    assert selection.quotas(10, 0.6, 100, 100) == (6, 4)
    for target in range(0, 25):
        for first in range(0, 12):
            for second in range(0, 12):
                a, b = selection.quotas(target, 0.6, first, second)
                assert a + b == min(target, first + second) and a <= first and b <= second


def test_selection(spark):
    c = spark.createDataFrame([(f"https://a/{s}/{k}", s) for s in ("sql", "mig") for k in range(100)], "url string, section string")
    got = selection.balanced_sample(c, 10, first="sql", second="mig")
    assert {r["section"]: r["count"] for r in got.groupBy("section").count().collect()} == {"sql": 6, "mig": 4}
    assert sorted(r["ord"] for r in got.collect()) == list(range(1, 11))
    assert got.orderBy("ord").collect() == selection.balanced_sample(c, 10, first="sql", second="mig").orderBy("ord").collect()
    with pytest.raises(selection.RunAborted):
        selection.assert_allowed(got, selection.robots_allowed("url", [("https://a/sql/1", True), ("https://a/sql", False)]))
    selection.assert_allowed(got, selection.robots_allowed("url", []))
    with pytest.raises(ValueError):
        selection.fetch_schedule(got, 0)
    with pytest.raises(ValueError, match="mig"):
        selection.cast_section(c, ("sql",))


def test_robots_rules():
    text = "# x\nUser-agent: Mill\nUser-agent: other\nDisallow: /a\nAllow: /\n\nUser-agent: *\nDisallow:\n"
    assert selection.parse_robots(text, "mill/2.0") == [("/a", False), ("/", True)]
    assert selection.parse_robots(text, "someone") == [("", True)]
    assert selection.parse_robots(None, "mill") == []
    assert selection.parse_robots("User-agent: *\nDisallow: /", "x") == [("/", False)]


def test_fail_gate(spark):
    for failed, bad in ((3, False), (4, True)):
        docs = spark.createDataFrame([("failed",)] * failed + [("success",)] * (10 - failed) + [("skipped",)] * 5, "status string")
        assert selection.run_counters(docs).first()["aborted"] is bad
    assert selection.run_counters(spark.createDataFrame([("skipped",)], "status string")).first()["fail_rate"] == 0.0


def incoming(spark, rows):
    return spark.createDataFrame([(u, i, "t", "sql", None, c, [1.0], 3, "{}", k) for k, (u, i, c) in enumerate(rows)], "doc_url string, chunk_index int, doc_title string, section string, heading_path string, content string, embedding array<float>, token_count int, metadata string, pos int")


def test_versioned_store(spark, tmp_path):
    s = store.VersionedStore(spark, f"file://{tmp_path}/store")
    assert s.healthy() and s.read().count() == 0
    assert s.upsert(incoming(spark, [("a", 0, "x"), ("a", 1, "y"), ("b", 0, "z"), ("b", 0, "w")])) == {"chunks_created": 3, "chunks_updated": 1, "chunks_deleted": 0}
    first = {(r["doc_url"], r["chunk_index"]): r for r in s.read().collect()}
    assert sorted(r["id"] for r in first.values()) == [1, 2, 3] and first["b", 0]["content"] == "w"
    assert s.upsert(incoming(spark, [("a", 0, "x2"), ("c", 0, "n")])) == {"chunks_created": 1, "chunks_updated": 1, "chunks_deleted": 1}
    after = {(r["doc_url"], r["chunk_index"]): r for r in s.read().collect()}
    assert set(after) == {("a", 0), ("b", 0), ("c", 0)}  # b vanished from the input and stays
    assert after["a", 0]["id"] == first["a", 0]["id"] and after["a", 0]["created_at"] == first["a", 0]["created_at"] and after["a", 0]["content"] == "x2" and after["c", 0]["id"] == 4
    assert s.upsert(incoming(spark, [("a", 0, "x2"), ("c", 0, "n")])) == {"chunks_created": 0, "chunks_updated": 2, "chunks_deleted": 0}
    assert s.healthy()


def sections_of(s):
    return s._head()[1]["sections"]


def test_an_upsert_rewrites_touched_sections_only(spark, tmp_path):
    s = store.VersionedStore(spark, f"file://{tmp_path}/store")
    s.upsert(incoming(spark, [("a", 0, "x")]).union(incoming(spark, [("m", 0, "y"), ("m", 1, "z")]).withColumn("section", F.lit("mig"))))
    before = sections_of(s)
    assert s.upsert(incoming(spark, [("b", 0, "new")])) == {"chunks_created": 1, "chunks_updated": 0, "chunks_deleted": 0}
    assert len([d for d in sections_of(s).values() if d in before.values()]) == 1 and s.read().count() == 4
    # A document that moves to another section takes its old rows along.
    assert s.upsert(incoming(spark, [("m", 0, "moved")])) == {"chunks_created": 0, "chunks_updated": 1, "chunks_deleted": 1}
    assert {(r["doc_url"], r["section"], r["id"]) for r in s.read().collect()} >= {("b", "sql", 4)}
    assert {(r["doc_url"], r["chunk_index"], r["section"]) for r in s.read().collect()} == {("a", 0, "sql"), ("b", 0, "sql"), ("m", 0, "sql")}


def test_a_second_writer_and_a_failed_one_change_nothing(spark, tmp_path):
    s = store.VersionedStore(spark, f"file://{tmp_path}/store")
    s.upsert(incoming(spark, [("a", 0, "x")]))
    number, head = s._head()
    s.upsert(incoming(spark, [("b", 0, "y")]))
    with pytest.raises(store.ConcurrentWrite):
        s._commit(number + 1, head)
    (tmp_path / "store/log/.draft-broken").write_text("")  # what a writer leaves that died while writing
    with pytest.raises(Exception):
        s.upsert(incoming(spark, [("c", 0, "y")]).withColumn("token_count", F.raise_error(F.lit("stop")).cast("int")))
    assert s.version() == number + 1 and s.read().count() == 2 and s.healthy()


def test_ensure_schema_twice(spark):
    for _ in range(2):
        store.ensure_schema(spark, "chunks_of_a_test")
    assert spark.table("chunks_of_a_test").count() == 0
    spark.sql("drop table chunks_of_a_test")


def test_ids_are_dense(spark):
    made = [(f"d{k % 37}", k // 37, "x") for k in range(300)]
    out = store.upsert(spark.createDataFrame([], store.SCHEMA), incoming(spark, made)).collect()
    assert sorted(r["id"] for r in out) == list(range(1, 301))


def test_embedding(spark):
    docs = spark.createDataFrame([(k, f"text {k}") for k in range(7)], "k int, content string")
    p = embedding.hash_provider(8)
    out = {r["k"]: r["embedding"] for r in embedding.embed_texts(docs, p, dimension=8, batch=2).collect()}
    assert all(out[k] == pytest.approx(p([f"text {k}"])[0], abs=1e-6) for k in range(7))
    with pytest.raises(Exception, match="contract"):
        embedding.embed_texts(docs, p, dimension=9).collect()
    assert [r["texts"] for r in embedding.batch_plan(docs, 3, order="k").orderBy("batch").collect()] == [3, 3, 1]
    assert embedding.batch_plan(docs.limit(0), 3, order="k").count() == 0
    assert embedding.estimate_cost(3000, "text-embedding-3-small") == pytest.approx(0.00006)
    with pytest.raises(ValueError):
        embedding.estimate_cost(1, "none")
    assert embedding.by_index([(1, [2.0]), (0, [1.0])]) == [[1.0], [2.0]] and embedding.by_index([[3.0]]) == [[3.0]]
    turned = {r["k"]: r["embedding"] for r in embedding.embed_texts(docs, lambda t: list(enumerate(p(t)))[::-1], dimension=8, batch=3).collect()}
    assert turned == out
    assert embedding.cost_confirmed(0.10) and not embedding.cost_confirmed(0.11) and embedding.cost_confirmed(5, lambda _: " Sí ")


def test_retry():
    waits, calls = [], []

    def flaky(texts):
        calls.append(1)
        if len(calls) < 4:
            raise embedding.Retryable
        return [[0.0]] * len(texts)

    assert embedding.with_retry(flaky, ["a"], sleep=waits.append) == [[0.0]] and waits == [2, 4, 8]
    with pytest.raises(embedding.Retryable):
        embedding.with_retry(lambda t: (_ for _ in ()).throw(embedding.Retryable()), ["a"], sleep=lambda s: None)


def test_report(spark):
    docs = spark.createDataFrame([("u2", "b", "success", 10, "T|1"), ("u1", "b", "success", 30, None), ("u3", "a", "failed", 0, "x")], "url string, section string, status string, word_count int, title string")
    listing = reporting.report_listing(docs).orderBy("n").collect()
    assert [(r["n"], r["url"], r["title"]) for r in listing] == [(1, "u3", "x"), (2, "u1", "—"), (3, "u2", "T\\|1")]
    words = reporting.word_count_stats(docs).first().asDict()
    assert words["median_words"] == 10 and words["mean_words"] == pytest.approx(13.3)
    text = reporting.render_report({"failed": 1}, reporting.status_by_section(docs).orderBy("section").collect(), words, {"severity": "NOTE", "empty_pct": 0.0, "docs_with_empty": 0, "docs": 3, "empty_total": 0}, [], listing, [])
    assert "| 3 | `b` | 10 | T\\|1 | <u2> |" in text and "> [!NOTE]" in text
    assert reporting.token_stats(spark.createDataFrame([], "token_count int")).first()["median_tokens"] is None


def test_search(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 3)
    monkeypatch.setattr(retrieval, "ROW_BLOCK", 7)
    data = [(k, [math.cos(k / 10), math.sin(k / 10)]) for k in range(20)] + [(20, [0.0, 0.0]), (21, None), (22, [1.0, 0.0, 0.0])]
    v = spark.createDataFrame(data, "k long, v array<double>")
    got = {}
    for r in retrieval.vector_topk(v.withColumnRenamed("k", "query_id"), v, 3, id_col="k", vec_col="v").orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["id"], r["score"]))
    dot = lambda a, b: round(sum(x * y for x, y in zip(a, b)), 9) if len(a) == len(b) else 0.0
    for k, x in data[:20]:
        assert got[k] == sorted(((j, dot(x, y)) for j, y in data if y), key=lambda t: (-t[1], t[0]))[:3]
    texts = ["a cat", "The cats", "dogs", "", "cat a"]
    t = spark.createDataFrame(list(enumerate(texts)), "k long, t string")
    pairs = {(r["query_id"], r["id"]): r["score"] for r in retrieval.trigram_topk(t.withColumnRenamed("k", "query_id"), t, 5, id_col="k", text_col="t").collect()}
    exact = t.alias("a").join(t.select(F.col("k").alias("j"), F.col("t").alias("u"))).select("k", "j", F.round(similarity(trigrams("t"), trigrams("u")), 9).alias("s"))
    assert pairs == {(r["k"], r["j"]): r["s"] for r in exact.collect()}
    a = spark.createDataFrame([(7, 1, 1), (7, 2, 2)], "query_id long, id long, rank int")
    b = spark.createDataFrame([(7, 2, 1), (7, 3, 2), (8, 1, 1)], "query_id long, id long, rank int")
    fused = retrieval.reciprocal_rank_fusion(a, b, 3).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["id"]) for r in fused] == [(7, 2), (7, 1), (7, 3), (8, 1)]


def test_stream_upserts_once(spark, tmp_path):
    src, schema = f"{tmp_path}/in", "doc_url string, doc_title string, section string, body string"
    spark.createDataFrame([("a", "A", "sql", "# H\ntext"), ("b", "B", "sql", "words")], schema).write.parquet(src)
    s = store.VersionedStore(spark, f"file://{tmp_path}/store")
    for _ in range(2):
        ingest.upsert_stream(ingest.stream_documents(spark, src, schema), s, f"{tmp_path}/ckpt").awaitTermination()
    assert {r["doc_url"] for r in s.read().collect()} == {"a", "b"}
    spark.createDataFrame([("a", "A", "sql", "new")], schema).write.mode("append").parquet(src)
    ingest.upsert_stream(ingest.stream_documents(spark, src, schema), s, f"{tmp_path}/ckpt").awaitTermination()
    assert {r["doc_url"]: r["content"] for r in s.read().collect()} == {"a": "new", "b": "words"}
