"""Results against brute force, round trips and held-out accuracy on small tables."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from corpusmill.llm import boosting, exact_dedup, html_text, language_id, mixing, near_dedup, near_vectors, packing, token_counts, toxicity
from corpusmill.llm.binary_fuse import BinaryFuse8
from corpusmill.llm.common import connected_components
from corpusmill.llm.dom import Page, node_features
from corpusmill.llm.tokens import borders_of, default_vocabulary, token_ids
from corpusmill.llm.warc import capture_log, parse_records, resolve_revisits
from corpusmill.staging import stage

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DIR}/documents.parquet")


@given(st.lists(st.integers(-(2**63), 2**63 - 1), max_size=400))
@settings(max_examples=60, deadline=None)
def test_filter_has_no_false_negative(keys):
    assert BinaryFuse8.build(np.array(keys, dtype=np.int64)).contains(np.array(keys, dtype=np.int64)).all()


def test_filter_refuses_nearly_all_others():
    rng = np.random.default_rng(1)
    f = BinaryFuse8.build(rng.integers(-(2**62), 2**62, 20_000))
    assert f.contains(rng.integers(-(2**62), 2**62, 50_000)).mean() < 0.006


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


@given(st.lists(st.integers(0, 6), min_size=1, max_size=40), st.lists(st.integers(0, 6), min_size=1, max_size=40), st.sampled_from([0.3, 0.5, 0.8, 0.95]), st.booleans())
@settings(max_examples=300, deadline=None)
def test_banded_alignment(a, b, s, near):
    b = a[: len(a) // 2] + b[:2] + a[len(a) // 2 + 1 :] if near else b
    c = lcs(a, b)
    assert near_dedup.aligned(np.array(a, dtype="<u4"), np.array(b, dtype="<u4"), s) == (c / (len(a) + len(b) - c) >= s - 1e-12)


def test_components(spark):
    rng = random.Random(2)
    chain = [(k, k + 1) for k in range(1000, 1200)]
    edges = chain + [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(250)] + [(5000, k) for k in range(5001, 5300)] + [(None, 7), (8, 8)]
    root = {x: x for e in edges for x in e if x is not None and e[0] is not None and e[0] != e[1]}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}


def test_near_dedup_against_all_pairs(spark, docs):
    base = {r["doc_id"]: r["text"] for r in docs.collect()}
    rng, planted = random.Random(4), {}
    for k, (i, t) in enumerate(sorted(base.items())[:40]):
        w = t.split()
        if len(w) > 150:
            for _ in range(2):
                w[rng.randrange(len(w))] = "changed"
            planted[10_000 + k] = " ".join(w)
    both = base | planted
    out = {r["doc_id"]: r["class_id"] for r in near_dedup.near_dedup(spark.createDataFrame(list(both.items()), "doc_id long, text string")).collect()}
    shingles = {i: near_dedup.shingle_hashes(near_dedup.word_hashes(t)) for i, t in both.items()}
    ids, root = sorted(both), {i: i for i in both}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            a, b = shingles[i], shingles[j]
            if (len(a) == len(b) == 0) or (min(len(a), len(b)) and near_dedup.aligned(a, b)):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    assert out == {i: find(i) for i in ids}
    assert len(planted) > 10 and all(out[10_000 + k] != 10_000 + k for k in (p - 10_000 for p in planted))


def test_near_dedup_links_across_a_large_bucket_s_pivot(spark):
    """Text 900 resembles the base text 800 alone, which the pivots of all their buckets tie to a large group."""
    rng = random.Random(5)
    base = [f"w{k}" for k in range(200)]

    def changed(places):
        return " ".join(f"x{rng.random()}" if k in places else w for k, w in enumerate(base))

    texts = {k: changed({30 + 2 * k}) for k in range(60)} | {800: " ".join(base), 900: changed({5, 10, 15, 199 - 5})}
    s = {i: near_dedup.shingle_hashes(near_dedup.word_hashes(t)) for i, t in texts.items()}
    assert [i for i in texts if i != 900 and near_dedup.aligned(s[i], s[900])] == [800]
    out = near_dedup.near_dedup(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert {r["class_id"] for r in out} == {0}


@pytest.mark.parametrize("members, small", [(33, 32), (120, 100_000), (200, 32), (2000, 32)])
def test_near_dedup_ties_a_large_bucket_by_its_hub(spark, members, small):
    """Texts that resemble a hub alone, not each other, and a short one that resembles the hub alone: one class."""
    hub = [f"h{k}" for k in range(600)]
    texts = {k: " ".join(hub + [f"t{k}_{j}" for j in range(126)]) for k in range(members)} | {10_000: " ".join(hub), 10_001: " ".join(hub[:540])}
    s = {i: near_dedup.shingle_hashes(near_dedup.word_hashes(texts[i])) for i in (0, 1, 10_000, 10_001)}
    assert [near_dedup.aligned(s[a], s[b]) for a, b in ((0, 10_000), (10_000, 10_001), (0, 1), (0, 10_001))] == [True, True, False, False]
    out = near_dedup.near_dedup(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), small_bucket=small).collect()
    assert {r["class_id"] for r in out} == {0} and len(out) == members + 2


def test_near_dedup_finds_all_short_pairs(spark):
    """An 8-word text and the same with a word added have a similarity of 0.8 and few sketches in common."""
    rng = random.Random(6)
    texts = {}
    for k in range(600):
        w = [f"w{rng.random()}" for _ in range(8)]
        texts |= {2 * k: " ".join(w), 2 * k + 1: " ".join([*w, "more"])}
    out = near_dedup.near_dedup(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert all(r["class_id"] == r["doc_id"] // 2 * 2 for r in out)


def vector_result(spark, vectors):
    out = near_vectors.near_vectors(spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>")).collect()
    return {r["vec_id"]: (r["n_links"], r["component_id"]) for r in out}


def test_near_vectors_links_dense_groups_by_one_border_link(spark):
    """Vectors 39 and 40 alone link two groups whose members have their 8 nearest in their own group."""
    degrees = [0.005 * k for k in range(39)] + [0.4, 18.55] + [18.65 + 0.003 * k for k in range(39)]
    vectors = {k: [float(np.cos(np.radians(d))), float(np.sin(np.radians(d)))] for k, d in enumerate(degrees)}
    got = vector_result(spark, vectors)
    assert got == {k: (40 if k in (39, 40) else 39, 0) for k in vectors}


def test_near_vectors_finds_bridges_between_tight_clusters(spark, sample=32):
    """Pairs of clusters of 12 hang together by one vector, whose nearest are all of its own cluster."""
    rng, rows = np.random.default_rng(9), []
    turn = lambda a, c, deg: np.cos(np.radians(deg)) * a + np.sin(np.radians(deg)) * c
    for _ in range(60):
        q, _ = np.linalg.qr(rng.standard_normal((64, 2)))
        a, c = q.T
        for centre in [a] * 11 + [turn(a, c, 6.4)] + [turn(a, c, 21.6)] * 12:
            rows.append(centre + 0.0005 * rng.standard_normal(64))
    x = np.array(rows + list(rng.standard_normal((1560, 64))))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    hit = x @ x.T >= 0.95
    np.fill_diagonal(hit, False)
    root = np.arange(len(x))
    for a, b in zip(*np.nonzero(hit)):
        root[root == max(root[a], root[b])] = min(root[a], root[b])
    out = near_vectors.near_vectors(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>"), sample=sample).toPandas().sort_values("vec_id")
    assert len(set(root[:1440])) == 60
    assert np.minimum(out.n_links, hit.sum(axis=1)).sum() >= 0.99 * hit.sum() and (out.component_id.to_numpy() == root).mean() > 0.99


def test_near_vectors_compares_all_on_request(spark, monkeypatch):
    """The first graph finds a large group's links and no pair's; most links of the table are the group's."""
    rng, graph = np.random.default_rng(3), near_vectors.first_graph
    centres = rng.standard_normal((11, 64))
    rows = [centres[0] + 0.001 * rng.standard_normal(64) for _ in range(100)] + [c + 0.001 * rng.standard_normal(64) for c in centres[1:] for _ in range(2)]
    monkeypatch.setattr(near_vectors, "first_graph", lambda *a, **b: graph(*a, **b).where("u < 100 and v < 100"))
    out = near_vectors.near_vectors(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(rows)], "vec_id long, embedding array<double>"), exhaustive=True).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in out} == {k: (99, 0) for k in range(100)} | {k: (1, k // 2 * 2) for k in range(100, 120)}


@pytest.mark.parametrize("n, pairs, size", [(2000, 0, 2), (2000, 300, 2), (20_100, 100, 2), (6000, 100, 20)])
def test_near_vectors_takes_a_tenth_of_all_products(spark, n, pairs, size):
    """Random vectors with groups planted at the threshold and above: recall, and products counted."""
    rng = np.random.default_rng(n + pairs)
    x = rng.standard_normal((n, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for g in range(pairs):
        for k in range(1, size):
            off = rng.standard_normal(64)
            off -= (off @ x[g * size]) * x[g * size]
            c = rng.uniform(0.951, 0.999) if size == 2 else 0.985
            x[g * size + k] = c * x[g * size] + np.sqrt(1 - c * c) * off / np.linalg.norm(off)
    want = {(a, b) for g in range(pairs) for a in range(g * size, (g + 1) * size) for b in range(a) if b >= g * size and x[a] @ x[b] >= 0.95}
    products = spark.sparkContext.accumulator(0)
    frame = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    out = near_vectors.near_vectors(frame, products=products).toPandas().set_index("vec_id").sort_index()
    assert 0 < products.value < n * n * (0.1 if size == 2 else 0.2)
    linked = sum(out.component_id[a] == out.component_id[b] for a, b in want)
    assert linked >= 0.99 * len(want) and out.n_links.sum() >= 0.99 * 2 * len(want)
    assert (out.n_links.iloc[pairs * size :] == 0).all()


def test_audit_intervals():
    none, some = near_vectors.Audit(100, 0, 0), near_vectors.Audit(100, 50, 49)
    assert none.interval == (0.0, 1.0) and "unmeasured" in str(none) and "3.0%" in str(none)
    low, high = some.interval
    assert low < 0.98 < high and 0.89 < low and high > 0.995


def test_pipeline_keeps_null_and_repeated_ids(spark):
    a, b, c, d = (" ".join(f"{t}{k}" for k in range(n)) for t, n in (("a", 20), ("b", 30), ("c", 40), ("d", 50)))
    rows = [(1, a), (1, b), (2, b), (None, c), (None, d), (None, d), (None, a), (3, c[:60]), (3, c[:60]), (3, d[:90])]
    docs = spark.createDataFrame([(i, t, "en", "s" if t != b else None, len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = Counter({(1, a): 1, (2, b): 1, (None, c): 1, (None, d): 1, (3, c[:60]): 1, (3, d[:90]): 1})
    for step in (corpus_pipeline.drop_copies, corpus_pipeline.drop_near_copies):
        docs = stage(step(spark, docs, ""), "test")
        assert Counter((r["doc_id"], r["text"]) for r in docs.collect()) == left
    size = {len(t.split()): t for _, t in rows}
    times = Counter({(r["doc_id"], size[r["size"]]): r["taken"] // r["size"] for r in mixing.mix(docs).collect()})
    assert Counter((r["doc_id"], r["text"]) for r in corpus_pipeline.mix_sources(spark, docs, "").collect()) == +times


def test_filters_screen_what_is_new(spark, docs):
    digests = docs.selectExpr("unhex(sha2(text, 256)) as _sha", "doc_id").cache()
    old, new = digests.where("doc_id % 2 = 0"), digests.where("doc_id % 2 = 1")
    passed = {bytes(r[0]) for r in exact_dedup.screen(new, exact_dedup.build_filters(old, 3), 3).collect()}
    known = {bytes(r[0]) for r in old.select("_sha").collect()} & {bytes(r[0]) for r in new.select("_sha").collect()}
    assert known <= passed and len(passed - known) <= 5


def test_kept_filters_screen_later_batches(spark, docs, tmp_path, monkeypatch):
    """A snapshot is hashed and its filters are built once; two batches against it give what all rows together give."""
    both = docs.select("doc_id", "text").union(docs.where("doc_id % 3 = 0").selectExpr("doc_id + 1000", "text")).union(docs.where("doc_id % 5 = 0").selectExpr("doc_id + 2000", "text"))
    old = both.where("doc_id < 120")
    exact_dedup.save_snapshot(old, f"file://{tmp_path}/kept")
    monkeypatch.setattr(exact_dedup, "build_filters", None)
    snapshot = exact_dedup.load_snapshot(old, f"file://{tmp_path}/kept")
    for batch in (both.where("doc_id between 120 and 999"), both.where("doc_id >= 1000")):
        rows = {r["doc_id"]: r["text"] or "" for r in old.union(batch).collect()}
        got = exact_dedup.dedup_batch(batch, snapshot).collect()
        assert {(r["doc_id"], r["keep_id"], r["group_size"]) for r in got} == {(i, max(j for j in rows if rows[j] == t), sum(u == t for u in rows.values())) for i, t in rows.items()}


def test_unique_texts_are_not_shuffled(spark):
    """What is left of all texts before the shuffle: the suspects' and next to nothing else."""
    rows = spark.range(4000).selectExpr("id as doc_id", "concat('text ', id) as _text").withColumn("_sha", exact_dedup.sha256(F.col("_text")))
    suspects = rows.where("doc_id % 100 = 0").select("doc_id", "_sha")
    left = {r["doc_id"] for r in exact_dedup.suspected(rows, suspects).collect()}
    assert {k for k in range(4000) if k % 100 == 0} <= left and len(left) <= 42
    assert exact_dedup.suspected(rows, suspects.limit(0)).count() == 0


@given(st.dictionaries(st.integers(1, 64), st.integers(1, 60), max_size=30))
@settings(max_examples=150, deadline=None)
def test_plan_places_every_piece(counts):
    p, used = packing.plan(counts, 64), {}
    for length, part in p.groupby("length"):
        ranks = []
        for r in part.itertuples():
            for k in range(r.count):
                ranks.append(r.rank + k)
                used.setdefault(r.sequence + k // r.each, []).append((r.offset + k % r.each * length, length))
        assert sorted(ranks) == list(range(counts[length]))
    for items in used.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= 64
    assert sorted(64 - sum(n for _, n in items) for items in used.values()) == one_by_one(counts, 64)


def one_by_one(counts, size):
    """The rooms that are left when pieces are placed singly, from the longest down, where they fit best."""
    rooms = []
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            k = min((k for k, r in enumerate(rooms) if r >= length), key=lambda k: rooms[k], default=None)
            if k is None:
                rooms.append(size - length)
            else:
                rooms[k] -= length
    return sorted(rooms)


def test_pieces_are_the_documents_ids(spark, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_vocabulary())
    some = {r["doc_id"]: r["text"] for r in docs.limit(60).collect()} | {900_001: "a <|endoftext|> b  \n\n c's<|endoftext|>d", 900_002: "", 900_003: "é\u0301 \U0001f600\u200d 12٣ ǅ \x00\u3000 x"}
    got = packing.pieces(spark.createDataFrame(list(some.items()), "doc_id long, text string"), 256).collect()
    for r in got:
        ids = np.array([*t.encode(some[r["doc_id"]], add_special_tokens=False).ids, 2], dtype="<u4")
        assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]])
        assert r["length"] == 256 or r["start"] == 0
    assert {r["doc_id"] for r in got} == set(some)


@pytest.mark.parametrize("rows_per_group", [1, 10**6])
def test_packing_whatever_its_groups(docs, rows_per_group):
    """As many groups as a group has pieces, and one group: the same pieces in as many sequences, none with a gap."""
    out = packing.pack(docs, 256, rows_per_group=rows_per_group).toPandas()
    every = packing.pieces(docs, 256).toPandas()
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, out[key].to_numpy().tolist())) == sorted(map(tuple, every[key].to_numpy().tolist()))
    assert out.sequence_id.nunique() == len(one_by_one(Counter(every.length.tolist()), 256))
    for _, s in out.sort_values("offset").groupby("sequence_id"):
        assert (s.offset == s.length.cumsum() - s.length).all() and s.length.sum() <= 256


def test_mixing_comes_near_its_targets(docs):
    out = mixing.mix(docs).toPandas().merge(docs.select("doc_id", "source").toPandas(), on="doc_id")
    by = out.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), size=("source_size", "first"), largest=("size", "max"))
    assert ((by.target - by.taken) >= 0).all() and ((by.target - by.taken) <= by.largest).all()
    assert abs(by.target.sum() - 1.5 * by["size"].sum()) < 1e-6 * by["size"].sum()


def test_languages_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = language_id.identify(docs, language_id.fit(docs, ~language_id.held_out())).join(docs.where(language_id.held_out()), "doc_id").toPandas()
    assert len(out) > 150 and (out.lang_pred == out.lang).mean() > 0.98


def test_nystrom_equals_the_kernel_machine():
    """With every training text a landmark, the collapsed weights give the scores of kernel ridge regression."""
    rng = random.Random(1)
    texts = [("a", " ".join("".join(rng.choice("abrcd") for _ in range(5)) for _ in range(20))) for _ in range(8)] + [("b", " ".join("".join(rng.choice("bryzx") for _ in range(5)) for _ in range(20))) for _ in range(8)]
    m = language_id.fit_rows(texts, ridge=0.05)
    seen = np.stack([_seen(t) for _, t in texts + [("", "abra zyx"), ("", "xyz rrr ccc")]])
    grams = [{n: {t[i : i + n] for t in [" " + " ".join(t.split()) + " "] for i in range(len(t) - n + 1)} for n in language_id.ORDERS} for _, t in texts + [("", "abra zyx"), ("", "xyz rrr ccc")]]
    kernel = np.array([[np.mean([len(a[n] & b[n]) / np.sqrt(len(a[n]) * len(b[n])) for n in a]) for b in grams] for a in grams])
    n = len(texts)
    target = np.array([[1.0, -1.0]] * 8 + [[-1.0, 1.0]] * 8)
    mean, centre = kernel[:, :n].mean(axis=1, keepdims=True), np.eye(n) - 1 / n
    dual = np.linalg.solve(centre @ kernel[:n, :n] @ centre + 0.05 * n * np.eye(n), target - target.mean(0))
    want = (kernel[:, :n] - kernel[:n, :n].mean(0)) @ centre @ dual + target.mean(0)
    assert mean.shape == (n + 2, 1) and np.allclose(language_id.normed(seen) @ m.weights + m.bias, want, atol=0.02)
    assert [m.languages[k] for k in m.predict(seen[:n])[0]] == [x for x, _ in texts]


def _seen(text):
    row = np.zeros(language_id.WIDTH, dtype=np.uint8)
    language_id.presence(text, row)
    return row


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    out = toxicity.score(docs, toxicity.fit(docs, labels, ~toxicity.held_out())).where(toxicity.held_out()).join(labels, "doc_id").toPandas()
    clean = out[out.toxic == 0]
    assert (clean.predicted == 0).mean() > 0.98 and out[out.toxic == 1].predicted.mean() > 0.5


def test_label_model_shares_the_weight_of_copies():
    rng = np.random.default_rng(0)
    y = rng.random(4000) < 0.2
    v = np.stack([(rng.random(4000) < np.where(y, 0.6, 0.01)) for _ in range(5)], axis=1)
    model = toxicity.LabelModel.fit(np.concatenate([v, v[:, :1], v[:, :1]], axis=1))
    assert model.weight[0] < 0.5 < model.weight[1]
    p = model.posterior(np.concatenate([v, v[:, :1], v[:, :1]], axis=1).astype(float))
    assert ((p > 0.5) == y).mean() > 0.93


def test_html_finds_articles(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").toPandas()
    model = html_text.fit_rows(list(pages.html[:40]))
    for html, text in zip(pages.html, html_text.main_texts(list(pages.html), model)):
        inner = html[html.index("<article>") : html.index("</article>")]
        assert text == "\n".join(b for b in _blocks(inner) if b)


def _blocks(html):
    import re
    from html import unescape

    return [" ".join(unescape(b.replace("<br>", " ")).split()) for b in re.split(r"</?(?:p|h1|article)>", re.sub(r"</?b>", "", html))]


@pytest.mark.parametrize("tag", ["article", "div class=zu", "section"])
def test_html_drops_no_text_of_an_article(tag):
    model = html_text.fit_rows([])
    close = tag.split()[0]
    for before in ("<head><title>name</title>", "<title>name</title>", "<html><head><meta charset=utf-8><title>name</title></head><body>"):
        html = f"{before}<{tag}><h1>Head</h1><p>A text, with <math><mi>x</mi></math> in it, and more to read.</p><![foo[ x ]]><p>After, one reads on, and on.<object>kept</object></p><noscript><p>Also this, for readers, is text.</p></noscript></{close}><footer>end</footer>"
        assert html_text.main_texts([html], model) == ["Head\nA text, with x in it, and more to read.\nAfter, one reads on, and on.kept\nAlso this, for readers, is text."]


def test_html_learns_the_table_s_own_names():
    """A name that no teaching page has, on parts that look like adverts, gets a score against it."""
    model = html_text.fit_rows([f"<body><article><p>Words of page {k}, and more of them, to read. And on.</p></article><div class='qqq ad'><a href=/>buy</a></div></body>" for k in range(20)])
    assert model.scores["qqq"] < -0.5 and "zzz" not in model.scores


def test_html_on_unseen_teaching_pages():
    rng, words = random.Random(77), "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    model = html_text.fit_rows([])
    wrong = total = 0.0
    for _ in range(120):
        page = Page(html_text.teaching_page(words, rng))
        y, keep = html_text.teaching_labels(page), model.keep([page])[0]
        own = np.expm1(node_features(page, model.scores)[:, 4])
        wrong, total = wrong + own[keep != (y > 0)].sum(), total + own.sum()
        assert all(keep[page.parents[k]] or not keep[k] for k in range(1, len(keep)))
    assert wrong / total < 0.04


def test_boosting_learns_an_interaction():
    rng = np.random.default_rng(3)
    x = rng.random((3000, 4)).astype(np.float32)
    y = ((x[:, 0] > 0.5) & (x[:, 1] < 0.3)).astype(float)
    assert ((boosting.BoostedTrees.fit(x, y).log_odds(x) > 0) == y).mean() > 0.99


@given(st.lists(st.sampled_from([*"ab c.,1'\n\tqjsé的一是ก!", "<|endoftext|>", "'s", "'re"]), max_size=200).map("".join), st.lists(st.tuples(st.integers(0, 210), st.integers(0, 12), st.text(alphabet="ab ,\n's的|<", max_size=8)), max_size=6), st.sampled_from([4, 16]))
@settings(max_examples=300, deadline=None)
def test_token_tree(text, edits, stride):
    encode, border = token_ids(default_vocabulary()), borders_of(default_vocabulary())
    tree = token_counts.TokenTree(text, lambda t: len(encode(t)) if t else 0, stride, border)
    assert tree.total == len(encode(text))
    for start, deleted, inserted in edits:
        at = min(start, len(text))
        text = text[:at] + inserted + text[at + deleted :]
        tree.edit(start, deleted, inserted)
        assert tree.text() == text and tree.total == len(encode(text)) and len(tree) == len(text)
        counted = []
        tree = token_counts.TokenTree.stored(text, tree.chars, tree.tokens, lambda t: counted.append(t) or (len(encode(t)) if t else 0), stride, border)
        assert not counted and tree.text() == text and tree.total == len(encode(text))


def test_leaves_are_short_whatever_the_text():
    """Words on lines, Chinese and Thai, random letters, base64, signs: no text of theirs has single blanks."""
    encode, border, rng = token_ids(default_vocabulary()), borders_of(default_vocabulary()), random.Random(8)
    draw = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    texts = ["\n".join(f"word{k % 977}" for k in range(20_000)), draw("的一是不了人我在有他这为之大来以个中上们", 120_000), draw("กขฃคฅฆงจฉช", 50_000)]
    texts += [draw("abcdefghijklmnopqrstuvwxyz", 50_000), draw("ABCabcxyzXYZ0123456789+/", 50_000), draw(".,;:!?()'-", 20_000), draw("éàüßñ ", 20_000)]
    for text in texts:
        tree = token_counts.TokenTree(text, lambda t: len(encode(t)) if t else 0, 512, border)
        assert max(map(len, tree.texts)) < 1024 and tree.total == len(encode(text))
        for k in range(4):
            at = rng.randrange(len(text))
            text = text[:at] + "x的" + text[at + 3 :]
            tree.edit(at, 3, "x的")
        assert tree.total == len(encode(text)) and tree.encoded_chars < 8 * 1024


def test_kept_trees_take_later_edit_logs(spark, docs):
    """Each log is joined to the trees that the one before left; only touched leaves are encoded, and no sum drifts."""
    encode = token_ids(default_vocabulary())
    some = docs.where("doc_id < 40 and length(text) > 4000").select("doc_id", "text")
    text = {r["doc_id"]: r["text"] for r in some.collect()}
    trees = token_counts.build_trees(some)
    for step in range(3):
        trees = stage(trees.select("doc_id", "text", "chars", "tokens"), "trees")
        edits = [(i, k, 700 * k + 31 * step, 5 * k, f" put in {step}") for i in sorted(text)[:-2] for k in (2, 1)]
        for i, _, at, gone, new in sorted(edits, key=lambda e: e[:2]):
            text[i] = text[i][:at] + new + text[i][at + gone :]
        trees = token_counts.edit_trees(token_counts.with_edits(trees, spark.createDataFrame(edits, "doc_id long, seq int, start long, deleted long, inserted string")))
        for r in trees.collect():
            assert r["text"] == text[r["doc_id"]] and r["tokens_after"] == len(encode(r["text"])) and r["chars_after"] == len(r["text"])
            assert r["leaves"] >= 7 and (1 <= r["leaves_encoded"] <= 6 if r["edits"] else r["leaves_encoded"] == 0)
            assert r["edits"] == (2 if r["doc_id"] in sorted(text)[:-2] else 0)


def test_revisits_against_a_loop(spark):
    rng = random.Random(6)
    data = [(k, f"http://h.example.org/{rng.choice('aaaaab')}", f"<p>{rng.randint(0, 2)}") for k in range(300)]
    records = parse_records(capture_log(spark.createDataFrame(data, "page_id long, url string, html string")))
    seen = [r.asDict() for r in records.collect()]
    for bucket in (1, 50, 10_000):
        got = {r["revisit_id"]: (r["response_id"], r["status_out"]) for r in resolve_revisits(records, rows_per_bucket=bucket).collect()}
        for r in (x for x in seen if x["warc_type"] == "revisit"):
            before = [x for x in seen if x["warc_type"] == "response" and x["target_uri"] == r["target_uri"] and x["date"] < r["date"]]
            want = max(before, key=lambda x: (x["date"], x["record_id"]), default=None)
            assert got[r["record_id"]][0] == (want and want["record_id"])


def record(kind, number, url, date, http, profile=None):
    more = f"\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/{profile}" if profile else ""
    return (f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: {number}\r\nWARC-Target-URI: {url}\r\nWARC-Date: {date}{more}\r\n\r\n{http}\r\n\r\n",)


def resolved(spark, records, **more):
    out = resolve_revisits(parse_records(spark.createDataFrame(records, "record string")), **more)
    return {r["revisit_id"]: (r["response_id"], r["status_out"]) for r in out.collect()}


def test_revisits_order_profiles_and_ports(spark):
    ok, same, not_modified = 'HTTP/1.1 200 OK\r\nETag: "a"', 'HTTP/1.1 304 Not Modified\r\nETag: W/"a"', "server-not-modified"
    records = [
        record("response", "f1", "http://h/x", "2024-01-01T00:00:00.100Z", ok),
        record("response", "f2", "https://h:443/x", "2024-01-01T00:00:00.500Z", ok),
        record("response", "f3", "http://h:443/x", "2024-01-01T00:00:00.600Z", ok),
        record("response", "f4", "http://h/x", "9999-12-31T00:00:00Z", ok),
        record("revisit", "r1", "http://h:80/x", "2024-01-01T00:00:00.300Z", same),
        record("revisit", "r2", "https://h/x", "2024-01-01T00:00:00.900Z", same, not_modified),
        record("revisit", "r3", "http://h/x", "2024-01-01T00:00:00.100Z", same),
        record("revisit", "r4", "http://h/x", "2024-01-01T00:00:02Z", 'HTTP/1.1 200 OK\r\nETag: "a"'),
        record("revisit", "r5", "http://h/x", "2024-01-01T00:00:02Z", same, "identical-payload-digest"),
        record("revisit", "r6", "http://h:443/x", "2024-01-02T00:00:00Z", same),
    ]
    for bucket in (1, 1000):
        assert resolved(spark, records, rows_per_bucket=bucket) == {"r1": ("f1", "resolved"), "r2": ("f2", "resolved"), "r3": (None, "no response"), "r4": (None, "other profile"), "r5": (None, "other profile"), "r6": ("f3", "resolved")}


def test_revisits_read_all_header_lines(spark):
    many = "".join(f"\r\nX-{k}: y" for k in range(120_000))
    records = [record("response", "f", "http://h/", "2024-01-01T00:00:00Z", f'HTTP/1.1 200 OK{many}\r\nETag: "z"'), record("revisit", "r", "http://h/", "2024-01-01T00:00:01Z", 'HTTP/1.1 304 x\r\nETag: "z"')]
    assert resolved(spark, records) == {"r": ("f", "resolved")}


@pytest.fixture(scope="module")
def pages(spark):
    """The pages of sf0.1 and a model fitted as the query does."""
    table = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    return [r["html"] for r in table.orderBy("page_id").collect()], html_text.fit(table)


_MENU = '<nav><ul><li><a href="/">Home</a></li><li><a href="/a">About</a></li></ul></nav>'
_LINKS = "".join(f'<li><a href="/p{k}">A paper number {k} on things</a></li>' for k in range(8))


@pytest.mark.parametrize(
    "inner, lines",
    [
        (f"<article><h1>Reading list</h1><p>What to read next, in short.</p><ul>{_LINKS}</ul><p>That is all, for now.</p></article>", 11),
        (f"<article><h1>Reading list</h1><ul>{_LINKS * 4}</ul></article>", 33),
        ('<article><p>Some words on code, which is below.</p><div class="highlight"><pre>x = 1\ny = 2</pre></div><p>And after it there is more.</p></article>', 3),
        ("<article><p>one is here, and it is text.</p><button>x<p>two follows the button that stays open.</p></article>", 3),
        ("<article><p>Some words on it, which is below.</p><figure><img src=x><figcaption>The figure caption says this.</figcaption></figure><p>More.</p></article>", 3),
        ("<article><h1>Terms</h1><dl><dt>One</dt><dd>The first of all numbers.</dd><dt>Two</dt><dd>The next one.</dd></dl></article>", 5),
        ('<div class="qx7"><p>Short text.</p></div>', 1),
        ('<div class="qx7"><h1>Short</h1><p>Short text.</p><p>More of it, in two parts.</p></div>', 3),
    ],
)
def test_articles_keep_all_their_parts(pages, inner, lines):
    text = html_text.main_texts([f"<html><body>{_MENU}{inner}</body></html>"], pages[1])[0]
    assert len(text.split("\n")) == lines and "Home" not in text and "About" not in text


def test_articles_under_unknown_names_keep_their_text(pages):
    """All pages of sf0.1, their articles renamed in six ways, give what they give as articles."""
    import re

    htmls, model = pages
    want = html_text.main_texts(htmls, model)
    assert all(want)
    for name in ("qx7", "c-12", "txt", "leaf col", "w9", "zub-lo"):
        renamed = [re.sub(r"<article(\s[^>]*)?>", f'<div class="{name}">', h).replace("</article>", "</div>") for h in htmls]
        got = html_text.main_texts(renamed, model)
        assert all(got) and sum(a != b for a, b in zip(want, got)) <= 5


@given(st.integers(2, 9), st.data())
@settings(max_examples=100, deadline=None)
def test_decoding_keeps_a_wanted_node_at_least_loss(n, data):
    """Against all sets of nodes that hold every node's parent."""
    parents = [-1] + [data.draw(st.integers(0, k - 1)) for k in range(1, n)]
    odds = np.array([0.0] + [data.draw(st.floats(-3, 3)) for _ in range(1, n)])
    wanted = np.array([False] + [data.draw(st.booleans()) for _ in range(1, n)])
    keep = html_text.decode(parents, odds, wanted)
    score = lambda s: sum(-np.logaddexp(0, -odds[k] if s[k] else odds[k]) for k in range(1, n) if s[parents[k]])
    sets = [s for m in range(1 << n) if (s := [bool(m >> k & 1) for k in range(n)])[0] and all(s[parents[k]] or not s[k] for k in range(1, n))]
    allowed = [s for s in sets if not wanted.any() or any(a and b for a, b in zip(s, wanted))]
    assert keep[0] and all(keep[parents[k]] or not keep[k] for k in range(1, n))
    assert not wanted.any() or (keep & wanted).any()
    assert score(list(keep)) >= max(map(score, allowed)) - 1e-9


def plain_label_model(v, rounds=40):
    """The label model's expectation maximisation, row by row and voter by voter."""
    from math import exp, log, sqrt

    n, m = len(v), len(v[0])
    weight, p = [1.0] * m, [0.9 if any(r) else 0.01 for r in v]

    def posteriors(prior, a, b):
        out = []
        for r in v:
            z = log(prior / (1 - prior)) + sum(weight[j] * (log(a[j] / b[j]) if r[j] else log((1 - a[j]) / (1 - b[j]))) for j in range(m))
            out.append(1 / (1 + exp(-min(40, max(-40, z)))))
        return out

    for k in range(2 * rounds):
        a = [(sum(p[i] for i in range(n) if v[i][j]) + 0.5) / (sum(p) + 2) for j in range(m)]
        b = [(sum(1 - p[i] for i in range(n) if v[i][j]) + 0.01) / (sum(1 - x for x in p) + 2) for j in range(m)]
        b = [min(min(0.5, max(1e-5, x)), y / 5) for x, y in zip(b, a)]
        a = [min(1 - 1e-4, max(1e-4, x)) for x in a]
        prior = min(0.5, max(1e-3, sum(p) / n))
        if k == rounds:
            cov = [[sum(p[i] * (v[i][x] - a[x]) * (v[i][y] - a[y]) for i in range(n)) / max(1, sum(p)) for y in range(m)] for x in range(m)]
            r = [[1.0 if x == y else min(1, max(0, cov[x][y] / sqrt(max(1e-9, cov[x][x])) / sqrt(max(1e-9, cov[y][y])))) for y in range(m)] for x in range(m)]
            weight = [1 / sum(c for c in row if c > 0.2) for row in r]
        p = posteriors(prior, a, b)
    return p


def test_label_model_against_a_plain_loop():
    rng = np.random.default_rng(6)
    y = rng.random(150) < 0.2
    v = np.stack([np.where(y, rng.random(150) < hit, rng.random(150) < 0.03) for hit in (0.9, 0.6, 0.5, 0.3)], axis=1)
    v = np.concatenate([v, v[:, 1:2] ^ (rng.random((150, 1)) < 0.02)], axis=1)  # a voter that copies another one
    got = toxicity.LabelModel.fit(v)
    want = plain_label_model(v.astype(int).tolist())
    assert np.allclose(got.posterior(v.astype(float)), want, atol=1e-6)
    assert got.weight[1] < 0.8 and got.weight[4] < 0.8 and ((np.array(want) > 0.5) == y).mean() > 0.93


def test_mined_terms_against_plain_counts():
    """Every candidate word and stem looked at by itself, families of copies counted once."""
    from math import log

    rng = random.Random(7)
    bad, common = ["grumph", "grumphing", "zlorp", "vexu"], [f"word{chr(97 + k)}" for k in range(12)]
    rows = []
    for k in range(160):
        toxic = k % 4 == 0
        rows.append(({*rng.sample(common, 5), f"own{chr(97 + k // 26)}{chr(97 + k % 26)}", *([rng.choice(bad)] if toxic else [])}, toxic))
    rows += [rows[0]] * 10
    seen, y = [s for s, _ in rows], np.array([float(t) for _, t in rows])
    sample = toxicity.Sample.of(seen, y > 0)
    family = [min(toxicity.hash_word(w) for w in s) for s in seen]
    share = lambda who: sum(y[i] for i in who) / len(who)
    by_family = {f: [i for i in range(len(rows)) if family[i] == f] for f in set(family)}
    base = min(0.5, max(1e-3, sum(map(share, by_family.values())) / len(by_family)))
    terms = {t for s, t_ in zip(seen, y) if t_ for t in toxicity.terms_of(s)}
    good = {}
    for t in terms:
        who = [i for i, s in enumerate(seen) if t in toxicity.terms_of(s)]
        if sum(y[i] for i in who) < 3:
            continue
        fams = {}
        for i in who:
            fams.setdefault(family[i], []).append(i)
        n, k = len(fams), sum(map(share, fams.values()))
        q = min(k / n, 1 - 1e-9)
        surprise = -n * (q * log(max(q, 1e-12) / base) + (1 - q) * log((1 - q) / (1 - base)))
        if n >= 3 and share(who) > 0.5 and k >= 2.4 and q > max(0.6, 2 * base) and surprise < log(toxicity.CHANCE / sample.looked_at):
            good[t] = k / (n + 2)
    kept = []
    for t in sorted(good, key=lambda t: (-good[t], -len(t), t)):
        bare = t.removesuffix("*")
        if not any(x.removesuffix("*").startswith(bare) for x in kept) and not any(x.endswith("*") and bare.startswith(x[:-1]) for x in kept):
            kept.append(t)
    assert sample.mine(y) == sorted(kept) and kept


def test_scores_against_a_plain_sum():
    model = toxicity.Model(["grum*", "zlorp"], -1.0, np.array([0.5, 1.0, 0.25, 0.125, 2.0, 4.0, 8.0]), np.linspace(-1, 1, toxicity.PLACES))
    texts = ["", "zlorp", "GRUMPHING zlorp! and zlorp", "nothing here of note", "grum", "GRUMPH " + "word " * 300, "a a a b"]
    for text, got in zip(texts, model.scores(texts)):
        words = toxicity.words_of(text)
        hits = [w for w in words if w == "zlorp" or (w.startswith("grum") and len(w) > 4)]
        z = -1.0 + sum({toxicity.place_of(w): model.places[toxicity.place_of(w)] for w in set(words) - set(hits)}.values())
        if hits:
            flags = [any(w != "zlorp" for w in hits), "zlorp" in hits, len(set(hits)) >= 2, len(hits) > len(set(hits)), len(hits) * 200 >= len(words), any(w.upper() in text for w in hits), any(f"{w}!" in text for w in hits)]
            z += sum(f * c for f, c in zip(flags, model.voters))
        assert abs(got - 1 / (1 + np.exp(-z))) < 1e-9
