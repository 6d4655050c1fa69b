"""Unit fixtures of text, HTML and source functions."""

import random
import re

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import html as H
from corpusmill.functions import text as T
from corpusmill.sources import documents as S
from corpusmill.sources import sinks


def one(spark, expr, **cols):
    names = list(cols) or ["x"]
    df = spark.createDataFrame([tuple(cols.values()) or (0,)], ", ".join(f"{n} {'string' if cols and isinstance(cols[n], (str, type(None))) else 'int'}" for n in names))
    return df.select(expr.alias("r")).first()["r"]


def test_markdown_cleaning(spark):
    md = one(spark, T.clean_markdown("x"), x="# Title[¶](https://a/b)\n\n\n\nText¶ here  ")
    assert md == "# Title\n\nText here\n"
    assert one(spark, T.clean_title("x"), x="  Title¶ ") == "Title"


def test_titles_and_slugs(spark):
    assert one(spark, T.title_from_url("x"), x="https://a/b/system$cancel_don't-stop/") == "System$Cancel Don'T Stop"
    assert one(spark, T.title_from_url("x"), x="https://a/__/") == "Untitled"
    assert one(spark, T.url_slug("x", "https://docs.example.com"), x="https://docs.example.com/en/sql/select//") == "en__sql__select"


def test_words_split_at_any_white_space(spark):
    for t in ("", "a", " a b c\x1dd\n", "x​y"):
        assert one(spark, T.word_count("x"), x=t) == len(t.split())
        assert one(spark, T.strip("x"), x=t) == t.strip()


def test_classify_and_errors(spark):
    rules = [("/en/sql/", "sql"), ("/en/", "other")]
    assert [one(spark, T.classify("x", rules), x=u) for u in ("https://a/en/sql/q", "https://a/en/z", "https://a/fr")] == ["sql", "other", None]
    assert one(spark, T.extraction_error("x"), x="") == "trafilatura no devolvió contenido"
    assert one(spark, T.extraction_error("x"), x="a b") == "contenido demasiado corto (2 palabras < 100)"
    assert one(spark, T.extraction_error("x"), x="w " * 100) is None


def test_front_matter_round_trip(spark):
    head = T.front_matter("u", "t", F.lit("sql"), F.lit("2026-01-02T03:04:05+00:00"), F.lit(7))
    raw = one(spark, F.concat(head, F.lit("# Body\n")), u="https://a/b", t='A "b"')
    assert raw.splitlines()[:3] == ["---", 'url: "https://a/b"', "title: \"A 'b'\""]
    loaded = S.load_markdown(spark.createDataFrame([(raw,), ("no header",), ("--- only",), (raw.replace("word_count: 7", "word_count: x"),)], "raw string")).collect()
    assert loaded[0]["body"] == "# Body\n" and loaded[0]["word_count"] == 7 and loaded[0]["reject"] is None
    assert [r["reject"] for r in loaded[1:]] == ["no front matter", "front matter is not closed", "missing or mistyped: word_count"]
    with pytest.raises(ValueError):
        S.good_documents(S.load_markdown(spark.createDataFrame([("x",)], "raw string")))
    assert one(spark, T.strip_front_matter("x"), x="---\na: b\n---\nrest") == "rest"
    assert one(spark, T.strip_front_matter("x"), x="---\nopen") == "---\nopen"


def test_sitemaps(spark):
    ns = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'
    index = f"<?xml version='1.0'?><sitemapindex {ns}><sitemap><loc> c1 </loc></sitemap><sitemap><loc>lost</loc></sitemap><sitemap><loc>c2</loc></sitemap></sitemapindex>"
    urls = lambda *u: f"<urlset {ns}>" + "".join(f"<url><loc>\n{x} </loc></url>" for x in u) + "</urlset>"
    root = spark.createDataFrame([(index,)], "xml string")
    children = spark.createDataFrame([("c1", urls("https://a/en/1", "https://a/xx", "https://a/en/1")), ("c2", urls("https://a/en/2")), ("lost", None)], "loc string, xml string")
    got = [r["url"] for r in S.discover(root, children, [("/en/", "en")]).orderBy("ord").collect()]
    assert got == ["https://a/en/1", "https://a/en/1", "https://a/en/2"]
    broken = spark.createDataFrame([("<urlset><url><loc>x</loc>",), ("junk",), (None,), (urls("y"),)], "xml string")
    assert [r["loc"] for r in S.parse_sitemaps(broken).collect()] == ["y"]


CODE = '<p>x</p><div class="codeblock-wrapper dark"><button>Copy</button><pre><code><span>SELECT</span> <span>f</span><span>(1)</span>\n<span>FROM t &lt; 2</span></code></pre></div><p>y</p>'


def test_code_wrappers(spark):
    out = one(spark, H.strip_code_wrappers("x"), x=CODE)
    assert out == "<p>x</p><pre>SELECT f(1)\nFROM t &lt; 2</pre><p>y</p>"
    plain = "<p>nothing to do</p>"
    assert one(spark, H.strip_code_wrappers("x"), x=plain) == plain
    assert one(spark, H.strip_code_wrappers("x"), x="<h1>SYSTEM$A_<wbr/>B</h1>") == "<h1>SYSTEM$A_B</h1>"
    bare = '<div class="codeblock-wrapper"><b>no pre</b></div>'
    assert one(spark, H.strip_code_wrappers("x"), x=bare) == bare


def test_to_markdown():
    html = '<body><nav>menu</nav><article><h1>T</h1><p>A <b>bold</b> <a href="/l">link</a>.<ul><li>one<li>two</ul><table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td>2</td></tr></table><div class="ad">buy</div>' + CODE + "</article><footer>f</footer></body>"
    md = H.to_markdown(html)
    assert "# T" in md and "A **bold** [link](/l)." in md and "- one" in md and "| 1 | 2 |" in md and "```\nSELECT f(1)\nFROM t < 2\n```" in md
    assert not re.search("menu|buy|Copy|\nf", md)


def test_nested_articles_stay_whole():
    md = H.to_markdown("<body>menu<article><p>one</p><article><p>two</p></article><p>three</p></article><p>end</p></body>")
    assert md.split() == ["one", "two", "three"]


@pytest.mark.parametrize("html", [
    "<html><head><title>t</title><article><p>kept</p></article>",
    "<html><head><title>t</title><p>kept</p>",
    "<head><title>t</title>kept",
    "<head><title>t</title></head><body><!-- <article> --><p>kept</p></body>",
    "<title>t</title><script>x = '<main>'</script><p>kept</p>",
    "<body><article></article><main><p>kept</p></main></body>",
    "<head><title>t</title><style>p {}</style><meta name='a'></head><p>kept</p>",
])
def test_to_markdown_finds_the_text_of_odd_pages(html):
    assert H.to_markdown(html) == "kept"


def test_markdown_keeps_the_words_of_all_pages(spark):
    """Against a plain reading of the pages' one template."""
    from html import unescape

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    for r in H.extract_pages(pages).select("html", "markdown").collect():
        inner = r["html"][r["html"].index("<article>") : r["html"].index("</article>")]
        plain = re.sub(r"[*#]", " ", r["markdown"])
        assert plain.split() == re.sub(r"[*#]", " ", unescape(re.sub(r"<(?:p|br|/p|h1|/h1)>", " ", re.sub(r"</?(?:b|article)>", "", inner)))).split()


def test_vector_literals_read_back(spark):
    import numpy as np

    for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("embedding", T.vector_literal("embedding").alias("t")).collect():
        assert np.array_equal(np.array(r["t"].strip("[]").split(","), dtype=np.float32), np.array(r["embedding"], dtype=np.float32))


def test_manifest_round_trip(spark, tmp_path):
    docs = spark.createDataFrame([(1, "u1", "T", "sql", "a.html", "a.md", "2026-01-01T00:00:00Z", 5, "success", None), (2, "u2", None, "sql", None, None, "2026-01-01T00:00:00Z", 0, "failed", "é")], "ord int, url string, title string, section string, html_raw_path string, markdown_path string, scraped_at string, word_count int, status string, error_message string")
    sinks.write_manifest(docs, str(tmp_path / "m"), 9, 1.5)
    m = spark.read.json(str(tmp_path / "m/counters"))
    assert m.first()["total_discovered"] == 9 and m.first()["total_failed"] == 1
    assert [r["error_message"] for r in S.read_manifest_documents(spark, str(tmp_path / "m")).orderBy("ord").collect()] == [None, "é"]
    one = '{"total_discovered": 2, "documents": [{"url": "u1", "status": "success"}, {"url": "u2", "error_message": "é"}]}'
    (tmp_path / "one.json").write_text(one)
    assert [r["error_message"] for r in S.manifest_documents(S.read_manifest(spark, str(tmp_path / "one.json"))).orderBy("ord").collect()] == [None, "é"]


def test_markdown_folder(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        S.read_markdown_folder(spark, str(tmp_path))
    for k in range(8):
        (tmp_path / f"d{k}.md").write_text(f"---\nx{k}\n---\nbody")
    files = S.read_markdown_folder(spark, str(tmp_path))
    assert files.count() == 8 and S.pilot(files).count() == 5


def test_trigrams(spark):
    assert set(one(spark, T.trigrams("x"), x="Cat")) == {"  c", " ca", "cat", "at "}
    assert one(spark, T.similarity(T.trigrams("x"), T.trigrams("y")), x="word", y="words") == pytest.approx(4 / 7)


def test_token_pattern(spark):
    import regex

    rng = random.Random(1)
    for _ in range(20):
        t = "".join(rng.choice("ab é1_.,\n\t-") for _ in range(40))
        assert one(spark, T.approx_tokens("x"), x=t) == len(regex.findall(T.TOKEN, t))


def test_text_behind_a_refused_marked_section_is_kept():
    from corpusmill.functions.html import clean_code, to_markdown

    for section in ("<![y]</p>", "<![ x ]>", "<![foo[x]]>", "<!["):
        html = f"<p>a</p>\n{section}<p>b</p>"
        assert "b" in to_markdown(html)
        code = f'{html}\n<div class="codeblock-wrapper"><pre>x</pre></div>tail'
        assert clean_code(code) == f"{html}\n<pre>x</pre>tail"


@pytest.mark.parametrize("name", ["page with-sidebar", "post has-comments", "social-sciences", "ad", "related"])
def test_pages_and_articles_stay_whatever_their_names(name):
    from corpusmill.functions.html import to_markdown

    for tag in ("body", "article", "main"):
        assert to_markdown(f'<html><body><{tag} class="{name}"><p>one</p></{tag}></body></html>') == "one"


def test_whole_names_are_noise():
    from corpusmill.functions.html import is_noise, to_markdown

    assert all(is_noise(n) for n in ("ad", "x ad-box", "sidebar_left", "cookie-notice", "Comments", "comment-list", "ads2", "related"))
    assert not any(is_noise(n) for n in ("", "with-sidebar", "has-comments", "social-sciences", "adequate", "download-share-price", "left", "-", "42"))
    assert to_markdown('<body><div class="social-sciences"><p>a</p></div><div class="ad-box"><p>b</p></div></body>') == "a"


def test_a_button_that_is_never_closed_swallows_nothing():
    from corpusmill.functions.html import to_markdown

    assert to_markdown("<p>one</p><button>x<p>two</p>").split() == ["one", "x", "two"]
    assert to_markdown("<p>one</p><button>x</button><p>two</p>").split() == ["one", "two"]
    assert to_markdown("<!-- <button> --><script>'<button>'</script><button>x</button><button>y<p>two</p>").split() == ["y", "two"]


def test_number_texts_are_those_of_the_client(spark):
    rng = random.Random(5)
    xs = [0.0, -0.0, 1.0, 0.1, 1e-4, 9.99e-5, 1e-5, 1.5e-7, 123456.789, 1e7, 12345678.9, 1e15, 1e16, 1.25e20, -2.5e-11, 1e100, 1e-300, float("inf"), float("-inf")]
    xs += [rng.uniform(-1, 1) * 10 ** rng.randint(-20, 20) for _ in range(200)]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select(T.number_text(F.col("x"))).collect()
    shape = lambda t: re.sub(r"[0-9]{12,}", "#", t)  # noqa: E731  older JVMs may write one digit more
    assert all(float(r[0]) == x and (r[0] == str(x) or shape(r[0]) == shape(str(x))) for r, x in zip(got, xs))
    assert sum(r[0] == str(x) for r, x in zip(got, xs)) > 0.8 * len(xs)
    v = spark.createDataFrame([([0.5, 1e-5, float("nan")],), ([],), (None,)], "x array<double>").select(T.vector_literal("x")).collect()
    assert [r[0] for r in v] == ["[0.5,1e-05,nan]", "[]", None]


def test_splitting_by_offsets_equals_splitting_by_counts():
    from corpusmill.functions.tokens import APPROXIMATE
    from corpusmill.operators.chunking import recursive_split

    rng = random.Random(1)
    for _ in range(1500):
        text = "".join(rng.choice(["word ", "a", "b. ", "\n", "\n\n", " ", "..", "x_1", "é", ". ", "!"]) for _ in range(rng.randint(0, 120)))
        size, overlap = rng.choice([3, 5, 10, 30]), rng.choice([0, 1, 2, 5])
        pieces = recursive_split(text, size, overlap, APPROXIMATE.count)
        assert recursive_split(text, size, overlap, APPROXIMATE.count, starts=APPROXIMATE.starts) == pieces
        assert all(APPROXIMATE.count(p) <= size or not any(s in p.strip() for s in ("\n\n", "\n", ". ", " ")) for p in pieces)


def test_vector_literals_are_those_of_their_sql(spark):
    import duckdb
    import numpy as np

    rng = np.random.default_rng(7)
    rows = [rng.uniform(-1, 1, 64).astype(np.float32) * np.float32(10.0) ** rng.integers(-6, 3) for _ in range(300)]
    rows += [np.arange(1, 65).astype(np.float32) * np.float32(p) for p in (2.0**-10, 2.0**-13, 3 * 2.0**-11, 50307.9375, 2530129.25, 16777218.0, 1e9)]
    text = lambda x: duckdb.execute("SELECT ?::FLOAT::VARCHAR", [float(x)]).fetchall()[0][0]
    got = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rows)], "i int, v array<float>").select("i", T.vector_literal("v").alias("t")).collect()
    assert all(r["t"] == "[" + ",".join(map(text, rows[r["i"]])) + "]" for r in got)
    odd = spark.createDataFrame([([1.0, None, 2e-45],), ([None],)], "v array<float>").select(T.vector_literal("v").alias("t")).collect()
    assert [r["t"] for r in odd] == ["[" + ",".join(map(text, (1.0, 2e-45))) + "]", "[]"]


def test_titles_are_decoded_as_far_as_their_sql_does(spark, tmp_path):
    import duckdb

    from corpusmill.plans.queries import ORACLE_SQL, QUERIES

    pages = [(1, "https://x/a", '<title>a = &quot;b&quot; &lt;c&gt; &amp;amp; &#39;</title>'), (2, "https://x/b", "<TITLE x>\n two \t words ¶</TITLE>"), (3, "https://x/c", "<p>none</p>"), (4, "https://x/d", None)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert sorted(map(tuple, QUERIES["extract_title"](spark, str(tmp_path)).collect())) == sorted(con.execute(ORACLE_SQL["extract_title"]).fetchall())
    row = spark.createDataFrame(pages[:1], "page_id long, url string, html string").select(H.page_title("html", "url").alias("t")).first()
    assert row["t"] == "a = \"b\" <c> &amp; '"


def test_texts_are_encoded_in_slices():
    import pyarrow as pa

    from corpusmill.functions import tokens

    texts = ["a" * n for n in (0, 5, 3, 20, 1, 1, 0)] + [None, "b"]
    got = list(tokens.slices(pa.array(texts), 8))
    assert [t for part in got for t in part] == [t or "" for t in texts]
    assert all(sum(map(len, part)) <= 8 or len(part) == 1 for part in got) and len(got) == 3
    assert [list(p) for p in tokens.slices(pa.array(texts).slice(3, 2), 8)] == [["a" * 20], ["a"]]


def test_only_pages_with_wrappers_go_to_python(spark):
    rows = spark.createDataFrame([("<p>a<wbr/>b</p>",), ("plain",), (f'<div class="{H.WRAPPER}"><pre>x</pre></div>',)], "html string")
    plan = rows.select(H.strip_code_wrappers("html"))._jdf.queryExecution().optimizedPlan().toString()
    assert "clean(CASE WHEN" in plan


def test_words_are_runs_without_any_white_space(spark):
    rng = random.Random(3)
    texts = ["", " ", " \x1c　", "a", " a", "a ", *("".join(rng.choice(["a", "é", "漢", "😀", "x", " ", "\xa0", "\n", " ", "​", "\x85", "\x1f", "\x00", "."]) for _ in range(rng.randint(0, 30))) for _ in range(500)), "é a" * 50000, "é" * 100000]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", T.word_count("t").alias("n")).collect()
    assert all(r["n"] == len(texts[r["i"]].split()) for r in got) and len(got) == len(texts)
    assert spark.createDataFrame([(None,)], "t string").select(T.word_count("t")).first()[0] is None


def test_words_of_found_documents_are_counted_once(spark):
    from corpusmill.plans import inputs

    found = inputs.documents_found(spark, "/root/testdata/sf0.001").where("word_count > 3")
    files = inputs.raw_files(spark, "/root/testdata/sf0.001").select("doc_id", T.front_matter_field("raw", r"^word_count:\s*(\d+)").alias("n")).where("n is not null")
    for rows in (found, files):
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("x{1680}") == 2  # both classes of one pattern
