"""Vector, trigram and keyword indexes against plain searches, with what they leave out; sessions in batch and stream."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.operators import keyword_index, retrieval, similarity_join, vector_index
from corpusmill.streaming import sessions

BIG, SMALL = "/root/testdata/sf0.1", "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.read.parquet(f"{BIG}/embeddings.parquet").select("vec_id", "embedding")


def test_vector_index_recall_and_share(spark, vectors, tmp_path):
    index = vector_index.build_index(vectors, id_col="vec_id", vec_col="embedding")
    assert index.rows.count() == vectors.count() and index.lists.agg(F.sum("n")).first()[0] == vectors.count()
    queries = vectors.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")
    want = {(r["query_id"], r["id"]) for r in retrieval.vector_topk(queries, vectors, 10, id_col="vec_id", vec_col="embedding").collect()}
    index.write(f"file://{tmp_path}/index")
    kept = vector_index.VectorIndex.read(spark, f"file://{tmp_path}/index")
    got = {(r["query_id"], r["id"]) for r in vector_index.search(kept, queries, 10, vec_col="embedding").collect()}
    assert kept.probes == index.probes < len(index.quantisers.lists) and len(got & want) >= 0.9 * len(want)
    share = [r["share"] for r in vector_index.share_read(kept, queries, vec_col="embedding").collect()]
    assert len(share) == queries.count() and 0 < np.mean(share) < 1
    few = {(r["query_id"], r["id"]) for r in vector_index.search(kept, queries, 10, vec_col="embedding", probes=1).collect()}
    assert 0 < len(few & want) < len(got & want)


def test_vector_index_reads_a_small_share_of_clustered_vectors(spark):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((40, 32))
    x = np.repeat(centres, 75, axis=0) + 0.3 * rng.standard_normal((3000, 32))
    v = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(x)], "vec_id long, embedding array<double>")
    queries = v.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")
    index = vector_index.build_index(v, id_col="vec_id", vec_col="embedding")
    found = lambda df: {(r["query_id"], r["id"]) for r in df.collect()}
    want = found(retrieval.vector_topk(queries, v, 10, id_col="vec_id", vec_col="embedding"))
    assert len(found(vector_index.search(index, queries, 10, vec_col="embedding", refine=5)) & want) >= 0.9 * len(want)
    assert vector_index.share_read(index, queries, vec_col="embedding").agg(F.avg("share")).first()[0] < 0.25


def test_vector_index_odd_rows(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]), (7, [0.0, 2.0]), (7, [0.0, 2.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    index = vector_index.build_index(v, id_col="vec_id", vec_col="embedding")
    assert index.rows.count() == 5
    q = v.withColumnRenamed("vec_id", "query_id")
    got = vector_index.search(index, q.where("query_id in (1, 3, 4, 6)"), 2, vec_col="embedding", probes=9).collect()
    assert [(r["query_id"], r["id"], r["score"], r["rank"]) for r in got] == [(1, 1, 1.0, 1), (1, 2, 1.0, 2)]
    empty = vector_index.build_index(v.limit(0), id_col="vec_id", vec_col="embedding")
    assert vector_index.search(empty, q, 2, vec_col="embedding").count() == 0
    with pytest.raises(ValueError, match="lengths"):
        vector_index.build_index(v.union(spark.createDataFrame([(9, [1.0])], v.schema)), id_col="vec_id", vec_col="embedding")


def test_large_lists_are_dealt_over_parts(spark, monkeypatch):
    monkeypatch.setattr(vector_index, "PART", 10)
    v = spark.createDataFrame([(k, [1.0, 0.001 * k]) for k in range(200)], "vec_id long, embedding array<double>")
    index = vector_index.build_index(v, id_col="vec_id", vec_col="embedding", lists=2)
    assert index.lists.agg(F.max("parts")).first()[0] > 5
    q = v.where("vec_id = 60").withColumnRenamed("vec_id", "query_id")
    want = retrieval.vector_topk(q, v, 5, id_col="vec_id", vec_col="embedding").collect()
    assert vector_index.search(index, q, 5, vec_col="embedding", probes=2).collect() == want


@pytest.mark.parametrize("threshold", [0.3, 0.6, 0.9])
def test_similarity_join_equals_all_pairs(spark, threshold):
    texts = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(1000, None), (1001, ""), (1002, "?!"), (1003, "cat"), (1004, "cat"), (1005, "Cat!"), (1050, "cats")], texts.schema)
    texts = texts.union(odd)
    queries = texts.where("doc_id % 50 = 0 or doc_id > 1000").withColumnRenamed("doc_id", "query_id")
    got = {(r["query_id"], r["id"]): r["score"] for r in similarity_join.similarity_join(queries, texts, threshold, id_col="doc_id", text_col="text").collect()}
    rows = [(r["doc_id"], retrieval.trigram_set(r["text"])) for r in texts.where("text is not null").collect()]
    sets = dict(rows)
    want = {(q, i): round(len(sets[q] & s) / len(sets[q] | s), 9) for q in sets if q % 50 == 0 or q > 1000 for i, s in rows if sets[q] and s and len(sets[q] & s) / len(sets[q] | s) >= threshold}
    assert got == want and (1003, 1005) in got


@pytest.mark.parametrize("threshold", [0.3, 0.6, 1.0])
def test_crowded_lists_are_left_for_blocks(spark, threshold, monkeypatch):
    rng = np.random.default_rng(8)
    words = ["".join(rng.choice(list("abc"), 4)) for _ in range(12)]
    rows = [(k, " ".join(rng.choice(words, rng.integers(1, 12)))) for k in range(400)]
    texts = spark.createDataFrame(rows, "doc_id long, text string")
    queries = texts.where("doc_id % 5 = 0").withColumnRenamed("doc_id", "query_id")
    monkeypatch.setattr(similarity_join, "ROW_BLOCK", 64)
    monkeypatch.setattr(similarity_join, "QUERY_BLOCK", 16)
    monkeypatch.setattr(similarity_join, "MEETING", 1000)
    monkeypatch.setattr(similarity_join, "candidate_pairs", None)  # not asked
    got = {(r["query_id"], r["id"]): r["score"] for r in similarity_join.similarity_join(queries, texts, threshold, id_col="doc_id", text_col="text").collect()}
    sets = {k: retrieval.trigram_set(t) for k, t in rows}
    score = {(q, i): len(sets[q] & sets[i]) / len(sets[q] | sets[i]) for q in sets if q % 5 == 0 for i in sets}
    assert got == {p: round(s, 9) for p, s in score.items() if s >= threshold} and len(got) >= 80


def test_shared_members_and_best_places():
    rng = np.random.default_rng(9)
    for n in (0, 1, 30):
        sets = [rng.choice(60, rng.integers(0, 40), replace=False) * (rng.integers(1, 3) if n > 5 else 1) for _ in range(2 * n)]
        q, r = sets[:n], sets[n:]
        want = np.array([[len(np.intersect1d(a, b)) for b in r] for a in q]).reshape(len(q), len(r))
        assert (retrieval.shared_members(q, r) == want).all()
    scores = rng.integers(0, 5, (20, 90)) / 4
    assert (retrieval.best_places(scores, 7) == np.argsort(-scores, axis=1, kind="stable")[:, :7]).all()


def test_similarity_join_meets_few_pairs(spark):
    texts = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sets = similarity_join.gram_sets(texts, id_col="doc_id", text_col="text").where("size(grams) > 0")
    counts = similarity_join.gram_counts(sets)
    p = similarity_join.prefixes(sets, counts, 0.8)
    pairs = similarity_join.candidate_pairs(p.where("id % 50 = 0"), p, 0.8).count()
    assert pairs < 0.25 * sets.count() * sets.where("id % 50 = 0").count()
    assert similarity_join.similarity_join(texts.limit(0).withColumnRenamed("doc_id", "query_id"), texts.limit(0), 0.8, id_col="doc_id", text_col="text").count() == 0


def brute_bm25(docs, queries, k):
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    by = {}
    for i, t in docs:
        by.setdefault(i, []).extend(words(t))
    mean, df = sum(map(len, by.values())) / max(1, len(by)), Counter(w for v in by.values() for w in set(v))
    out = set()
    for q, t in queries:
        scores = {}
        for i, v in by.items():
            n = Counter(v)
            shared = set(words(t)) & n.keys()
            if shared:
                scores[i] = round(sum(math.log(1 + (len(by) - df[w] + 0.5) / (df[w] + 0.5)) * n[w] * 2.2 / (n[w] + 1.2 * (0.25 + 0.75 * len(v) / mean)) for w in shared), 6)
        out |= {(q, i, s) for i, s in sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:k]}
    return out


def test_keyword_index(spark, tmp_path):
    docs = [(1, None), (2, ""), (3, "a b c"), (4, "a a a b"), (5, "a"), (5, "rare"), (6, "x " * 3000 + "rare"), (7, "A, b; C!"), (8, "d e f g"), (9, "ties"), (10, "ties")] + [(100 + k, f"a common word {k % 7}") for k in range(60)]
    queries = [(1, "a rare"), (2, "common word 3 a"), (3, None), (4, "nowhere"), (5, "ties"), (6, "A a a B c d")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    q = spark.createDataFrame(queries, "query_id long, text string")
    keyword_index.build_index(d).write(f"file://{tmp_path}/index")
    index = keyword_index.KeywordIndex.read(spark, f"file://{tmp_path}/index")
    for k in (1, 3, 100):
        assert {(r["query_id"], r["id"], round(r["score"], 6)) for r in keyword_index.search(index, q, k).collect()} == brute_bm25(docs, queries, k)
    assert keyword_index.search(keyword_index.build_index(d.limit(0)), q, 3).count() == 0


def test_keyword_index_scores_few_documents(spark):
    """Queries of benchmark passages: all documents share their frequent words, few are scored."""
    d, b = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "benchmark"))
    index, q = keyword_index.build_index(d), b.selectExpr("item_id as query_id", "text")
    found, asked = keyword_index.candidates(index, q, 10)
    every = index.postings.join(asked, "term").select("query_id", "id").distinct().count()
    assert found.count() < 0.5 * every


def test_sessions_in_a_stream_are_those_of_a_batch(spark, tmp_path):
    at = lambda m: f"2026-01-01T{m // 60:02d}:{m % 60:02d}:00"
    events = spark.createDataFrame([(u, at(m), 1.0) for u, m in [(1, 0), (1, 10), (1, 39), (1, 70), (1, 100), (2, 5), (None, 7), (None, 8), (2, 300), (1, 600), (2, 600), (1, 10)]] + [(3, None, 1.0)], "user_id int, ts string, value double").withColumn("ts", F.to_timestamp("ts"))
    total = {"total": F.sum("value")}
    batch = {tuple(r) for r in sessions.user_sessions(events, aggregates=total).collect()}
    lengths = sorted((str(r[0]), r[3]) for r in batch)
    assert lengths == [("1", 1), ("1", 1), ("1", 1), ("1", 4), ("2", 1), ("2", 1), ("2", 1), ("None", 2)] or sum(n for _, n in lengths) == 12
    path = f"{tmp_path}/events"
    for k, part in enumerate([events.where("ts < '2026-01-01 00:30:00'"), events.where("ts >= '2026-01-01 00:30:00' and ts < '2026-01-01 06:00:00'"), events.where("ts >= '2026-01-01 06:00:00' or ts is null")]):
        part.coalesce(1).write.mode("append").parquet(path)
    # Far behind the newest event: it comes too late.
    spark.createDataFrame([(9, at(0), 5.0)], "user_id int, ts string, value double").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(path)
    end = spark.createDataFrame([(8, "2026-01-03T00:00:00", 0.0)], "user_id int, ts string, value double").withColumn("ts", F.to_timestamp("ts"))
    end.coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(path)
    run = sessions.user_sessions(stream, late="1 hour", aggregates=total).writeStream.format("memory").queryName("sessions_out").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    run.awaitTermination(240)
    got = {tuple(r) for r in spark.table("sessions_out").collect()}
    assert got == batch


def test_queries_of_a_list_are_dealt_over_blocks(spark, monkeypatch):
    """Neither what a worker makes of a batch of queries nor what meets in one task grows with the number of queries."""
    v = spark.createDataFrame([(k, [1.0, 0.001 * k]) for k in range(600)], "vec_id long, embedding array<float>")
    index = vector_index.build_index(v, id_col="vec_id", vec_col="embedding", lists=3)
    q = v.withColumnRenamed("vec_id", "query_id")
    monkeypatch.setattr(vector_index, "QUERY_BLOCK", 20)
    chosen = vector_index.choices(index, q, vec_col="embedding", probes=3)
    assert chosen.count() == chosen.where("size(lists) = 3").count() == 600
    met = vector_index.blocks(index, chosen).where("ask").groupBy("list", "part", "block").count()
    assert met.count() == 90 and met.agg(F.max("count")).first()[0] < 60
    key = lambda df: {tuple(r) for r in df.collect()}
    assert key(vector_index.search(index, q, 5, vec_col="embedding", probes=3)) == key(retrieval.vector_topk(q, v, 5, id_col="vec_id", vec_col="embedding"))


def test_keyword_search_meets_queries_in_blocks_of_sets(spark, monkeypatch):
    """In any number of blocks; a query that comes twice is the set of its terms, each of which counts once."""
    docs = [(k, f"a common word {k % 7} " + "rare " * (k % 3)) for k in range(60)]
    queries = [(q, f"rare word {q} common") for q in range(9)]
    q = spark.createDataFrame(queries + queries[:3], "query_id long, text string")
    monkeypatch.setattr(keyword_index, "QUERY_BLOCK", 2)
    got = keyword_index.search(keyword_index.build_index(spark.createDataFrame(docs, "doc_id long, text string")), q, 4).collect()
    assert {(r["query_id"], r["id"], round(r["score"], 6)) for r in got} == brute_bm25(docs, queries, 4)
