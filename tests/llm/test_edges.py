"""Every operator on nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpusmill.llm import exact_dedup, html_text, language_id, mixing, near_dedup, near_vectors, packing, token_counts, toxicity, warc
from corpusmill.staging import stage

LONG = " ".join(f"word{k % 977}" for k in range(30_000))
CLASH = "_text string, _sha binary, key long, node long, a long, b long, n long, _id long, shard int, _h long, size long, _group int, component long, _times int"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {CLASH}"
CLASHES = (None,) * 14
DOCS = [
    (1, None, None, None, None),
    (2, "", "en", "a", 0),
    (3, LONG, "en", "a", len(LONG)),
    (4, LONG, "fr", "b", len(LONG)),
    (5, "one two", "en", None, 7),
    (5, "one two", "en", None, 7),
    (6, "one two", "de", "b", 7),
    (7, "??? 123 !!!", "de", "", 11),
    (None, "a text without an id", "en", "a", 20),
    (8, "퟿ \U0001f600 \x00 tail", "en", "c", 9),
    (9, "   \n\t ", None, "c", 6),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([d + CLASHES for d in DOCS], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_exact_dedup(docs, none):
    out = rows(exact_dedup.exact_dedup(docs, exact_dedup.batch_rule()))
    assert len(out) == len(DOCS)
    by = {r["doc_id"]: r for r in out}
    assert by[1]["keep_id"] == by[2]["keep_id"] == 2 and by[2]["kept"] and not by[1]["kept"]
    assert by[3]["keep_id"] == 4 and by[5]["keep_id"] == by[6]["keep_id"] == 6 and by[6]["group_size"] == 3
    assert by[None]["kept"] is False and by[None]["group_size"] == 1
    assert by[9]["group_size"] == 1  # nothing is normalised
    assert rows(exact_dedup.exact_dedup(none, exact_dedup.batch_rule())) == []


def test_exact_dedup_with_colliding_digests(docs):
    """A digest of two values: bytes decide, and a filter that passes everything changes nothing."""
    weak = lambda c: F.unhex(F.lpad(F.hex(F.length(c) % 2), 2, "0"))
    strong, poor = (sorted((r["doc_id"] or 0, r["keep_id"] or 0, r["group_size"], r["kept"]) for r in rows(exact_dedup.exact_dedup(docs, exact_dedup.batch_rule(), digest=d))) for d in (exact_dedup.sha256, weak))
    assert strong == poor


def test_near_dedup(docs, none):
    by = {r["doc_id"]: r for r in rows(near_dedup.near_dedup(docs))}
    assert by[1]["class_id"] == by[2]["class_id"] == by[9]["class_id"] == 1
    assert by[4]["class_id"] == 3 and by[5]["class_id"] == by[6]["class_id"] == 5 and by[6]["class_size"] == 3
    assert by[None]["class_id"] is None and by[None]["kept"]
    assert rows(near_dedup.near_dedup(none)) == []


def test_packing(docs, none):
    out = rows(packing.pack(docs, 64))
    assert sum(r["piece"] == 0 for r in out) == len(DOCS)
    for s in {r["sequence_id"] for r in out}:
        at = 0
        for r in sorted((r for r in out if r["sequence_id"] == s), key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 64
    assert [r["length"] for r in out if r["doc_id"] == 2] == [1]
    assert rows(packing.pack(none, 64)) == []


def test_near_vectors(spark):
    inf, nan = float("inf"), float("nan")
    data = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, []), (6, [0.0, 0.0]), (7, [nan, 1.0]), (8, [inf, 1.0]), (9, [None, 1.0]), (None, [1.0, 0.0]), (10, [1.0, 0.0, 0.0]), (11, [1.0, 0.1]), (12, [1e-30, 1e-31])]
    v = spark.createDataFrame([d + (None, None) for d in data], "vec_id long, embedding array<double>, node long, unit binary")
    out = {r["vec_id"]: r for r in rows(near_vectors.near_vectors(v))}
    assert out[1]["n_links"] == 4 and {out[k]["component_id"] for k in (1, 2, 11, 12)} == {1}
    assert all(out[k]["n_links"] == 0 and out[k]["component_id"] == k and out[k]["kept"] for k in (3, 4, 5, 6, 7, 8, 9, 10))
    assert out[None]["n_links"] == 0 and not out[None]["kept"]
    assert rows(near_vectors.near_vectors(v.limit(0))) == []


def test_toxicity(spark, docs, none):
    labels = spark.createDataFrame([(1, 0, 1, "x", 1), (2, 1, 0, "y", 1), (2, 1, 0, "y", 2), (99, 0, 1, None, None), (3, 1, None, "", 0)], "doc_id long, quality int, toxic int, text string, _t int")
    for d, l in ((docs, labels), (docs, labels.limit(0)), (none, labels)):
        out = rows(toxicity.score(d, toxicity.fit(d, l, ~toxicity.held_out())))
        assert len(out) == d.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in out)


def test_mixing(docs, none):
    out = rows(mixing.mix(docs))
    assert len(out) == len(DOCS) and all(r["taken"] in (0, r["size"], 2 * r["size"]) for r in out)
    assert next(r for r in out if r["doc_id"] == 1)["size"] == 0
    assert rows(mixing.mix(none)) == []


def test_html(spark):
    data = [(1, "u", None), (1, "u", None), (2, None, ""), (3, "u", "<p>" * 2000 + "deep"), (4, "u", "<![CDATA[ x <p>a &amp; b"), (None, "u", "<article><p>x</p></article>"), (5, "u", "<p>" + LONG)]
    pages = spark.createDataFrame([d + (None, None) for d in data], "page_id long, url string, html string, text string, _html string")
    model = html_text.fit(pages)
    out = rows(html_text.extract(pages, model))
    assert len(out) == len(data) and all(r["n_chars"] == len(r["text"]) for r in out)
    assert next(r for r in out if r["page_id"] == 5)["text"] == LONG
    assert rows(html_text.extract(pages.limit(0), html_text.fit(pages.limit(0)))) == []


def test_language(docs, none):
    model = language_id.fit(docs, ~language_id.held_out())
    out = {r["doc_id"]: r for r in rows(language_id.identify(docs, model))}
    assert out[1]["lang_pred"] == out[2]["lang_pred"] == out[7]["lang_pred"] == out[9]["lang_pred"] == "und"
    assert out[3]["lang_pred"] != "und"
    assert rows(language_id.identify(none, language_id.fit(none, ~language_id.held_out()))) == []
    assert language_id.identified_only(docs, model).columns == docs.columns


def test_warc(spark):
    pages = spark.createDataFrame([(1, "http://a/x", "<p>"), (2, "https://A/x/#f", "<p>"), (3, None, None), (None, "http://a/x", ""), (1, "http://a/x", "<p>")], "page_id long, url string, html string")
    out = rows(warc.resolve_revisits(warc.parse_records(warc.capture_log(pages))))
    assert len(out) == 5 and {r["status_out"] for r in out} <= {"resolved", "mismatch", "no response", "unverified"}
    odd = spark.createDataFrame([(None, 1), ("", 1), ("WARC/1.1", 1), ("x\r\n\r\ny\r\n\r\nz", 1)], "record string, it int")
    parsed = warc.parse_records(odd)
    assert parsed.count() == 4 and rows(warc.resolve_revisits(parsed)) == []


def test_token_counts(docs, none):
    out = rows(token_counts.count_tokens(docs, token_counts.derived_edits()))
    assert len(out) == len(DOCS)
    assert next(r for r in out if r["doc_id"] == 1)["tokens_before"] == 0
    assert rows(token_counts.count_tokens(none, token_counts.derived_edits())) == []


def test_pipeline(spark, docs):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    for d in (docs.select(columns), docs.select(columns).limit(0)):
        for k, (_, step) in enumerate(corpus_pipeline.STAGES):
            d = stage(step(spark, d, ""), "test")
            if k + 1 < len(corpus_pipeline.STAGES):
                assert d.columns == columns
    assert d.columns[:2] == ["doc_id", "piece"]


def test_refused_marked_sections_keep_what_follows():
    from corpusmill.llm.dom import Page

    for section in ("<![y]</p>", "<![ x ]>", "<![foo[x]]>", "<!["):
        assert "b" in "".join(p[2] for p in Page(f"<p>a</p>\n{section}<p>b</p>").pieces)
