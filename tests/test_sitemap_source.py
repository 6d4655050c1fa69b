"""The sitemap source: partitions, filters, and a stream that reads each snapshot once."""

import json

import pytest

from corpusmill.sources import sitemap_source as S

XML = '<?xml version="1.0" encoding="UTF-8"?>\n<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">{}</urlset>'
RULES = json.dumps([["/en/", "en"], ["/fr/", "fr"]])


def put(root, number, **files):
    d = root / f"snapshot={number}"
    d.mkdir(parents=True)
    for name, urls in files.items():
        (d / f"{name}.xml").write_text(XML.format("".join(f"<url><loc> {u} </loc></url>" for u in urls)) if isinstance(urls, list) else urls)


@pytest.fixture
def root(tmp_path):
    put(tmp_path / "s", 1, a=["h/en/1", "h/fr/1", "h/en/1", "h/x", ""], b=["h/en/2?a=1&amp;b=2"])
    put(tmp_path / "s", 2, a=["h/fr/2"], broken="<urlset><url><loc>h/en/8</loc></url><url><loc>h/en/9</urlset>", empty="", two=XML.format("<url><loc>h/en/3</loc></url>") + "\n" + XML.format("<url><loc>h/en/4</loc></url>"))
    (tmp_path / "s/other").mkdir()
    return f"{tmp_path}/s"


def load(spark, root, **more):
    S.register(spark)
    return spark.read.format(S.NAME).options(path=root, rules=RULES, files=1, **more).load()


def rows(df):
    return sorted((r["snapshot"], r["file"], r["ord"], r["url"], str(r["section"])) for r in df.collect())


WANT = [(1, "a.xml", 0, "h/en/1", "en"), (1, "a.xml", 1, "h/fr/1", "fr"), (1, "a.xml", 2, "h/en/1", "en"), (1, "a.xml", 3, "h/x", "None"), (1, "b.xml", 0, "h/en/2?a=1&b=2", "en"), (2, "a.xml", 0, "h/fr/2", "fr"), (2, "broken.xml", 0, "h/en/8", "en"), (2, "two.xml", 0, "h/en/3", "en"), (2, "two.xml", 1, "h/en/4", "en")]


@pytest.mark.parametrize("chunk", [1 << 20, 7])
def test_a_table(spark, root, chunk, monkeypatch):
    monkeypatch.setattr(S, "CHUNK", chunk)
    held = S._Snapshots({"path": root, "rules": RULES})
    assert sorted((n, f, k, u, str(s)) for p in held.partitions(held.numbers()) for n, f, k, u, s in held.rows(p)) == WANT
    df = load(spark, root)
    assert rows(df) == WANT and df.rdd.getNumPartitions() == 5
    assert rows(load(spark, f"file://{root}")) == WANT


def test_filters_are_pushed(spark, root):
    for text, keep in (("snapshot = 2", lambda r: r[0] == 2), ("snapshot > 1 and section = 'en'", lambda r: r[0] > 1 and r[4] == "en"), ("section = 'fr' and snapshot <= 1", lambda r: r[4] == "fr" and r[0] <= 1), ("section is null", lambda r: r[4] == "None"), ("section = 'en' and section = 'fr'", lambda r: False)):
        df = load(spark, root).where(text)
        assert rows(df) == [r for r in WANT if keep(r)]
    one = load(spark, root).where("snapshot = 1")
    assert one.rdd.getNumPartitions() == 2


def test_odd_folders(spark, tmp_path):
    assert load(spark, f"{tmp_path}/none").count() == 0
    with pytest.raises(Exception, match="path"):
        S.register(spark)
        spark.read.format(S.NAME).load().count()


def test_a_stream_reads_each_snapshot_once(spark, root, tmp_path):
    S.register(spark)

    def run():
        stream = spark.readStream.format(S.NAME).options(path=root, rules=RULES).load()
        stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(once=True).start().awaitTermination(200)
        return rows(spark.read.schema("snapshot bigint, file string, ord int, url string, section string").parquet(f"{tmp_path}/out"))

    assert run() == WANT
    put(tmp_path / "s", 3, new=["h/en/7"])
    assert run() == [*WANT, (3, "new.xml", 0, "h/en/7", "en")] == rows(load(spark, root))
    assert run() == rows(load(spark, root))
