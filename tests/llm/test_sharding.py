"""Rendezvous hashing against plain bids, its movements, and slots without gaps."""

import zlib
from collections import Counter, defaultdict
from hashlib import md5
from math import log

from pyspark.sql import functions as F

from corpusmill.llm.sharding import number_slots, shard_documents, shard_of, write_shards

SCHEMA = "doc_id long, text string, slot string, shard string, size string"


def winner(key, weights):
    u = [(int(md5(f"{i}:{'' if key is None else key}".encode()).hexdigest()[:13], 16) + 0.5) / 16**13 for i in range(len(weights))]
    return max((-w / log(x), i) for i, (w, x) in enumerate(zip(weights, u)) if w > 0)[1]


def gapless(rows):
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    return all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_bids_and_weights(spark):
    weights = [1.0, 2.0, 0.0, 4.0, 1.0]
    rows = spark.range(4000).select("id", shard_of("id", weights).alias("a"), shard_of("id", [*weights, 2.0]).alias("b"), shard_of("id", 5).alias("c")).collect()
    assert all(r["a"] == winner(r["id"], weights) and r["c"] == winner(r["id"], [1.0] * 5) for r in rows)
    share = Counter(r["a"] for r in rows)
    assert 2 not in share and all(abs(share[i] / 4000 - w / 8) < 0.03 for i, w in enumerate(weights))
    moved = [r for r in rows if r["a"] != r["b"]]
    assert all(r["b"] == 5 for r in moved) and abs(len(moved) / 4000 - 0.2) < 0.03


def test_odd_rows(spark):
    rows = [(None, None, "a", "b", "c"), (None, "x", None, None, None), (3, "", "a", "b", "c"), (3, "é" * 200_000, None, None, None)] + [(7, "same", None, None, None)] * 500 + [(k, "t", None, None, None) for k in range(300)]
    got = shard_documents(spark.createDataFrame(rows, SCHEMA)).collect()
    want = Counter((d, 8 + len((t or "").encode()), zlib.crc32((t or "").encode()), "key", winner(d, [1.0] * 24), winner(d, [1.0] * 25)) for d, t, *_ in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"], r["law"], r["shard"], r["grown_shard"]) for r in got) == want
    assert gapless(got)
    assert shard_documents(spark.createDataFrame([], SCHEMA)).collect() == []


def test_copies_are_given_out_in_parts(spark):
    rows = spark.range(900).select(F.least("id", F.lit(400)).alias("doc_id"), F.lit(0).alias("shard"))
    assert gapless(number_slots(rows, bucket=50, copies=64).collect())


def test_native_and_texts_stay(spark):
    plan = shard_documents(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "InPandas" not in plan


def test_writing(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    write_shards(docs, str(tmp_path / "out"), files=2)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == docs.count()
    assert back.where(F.col("shard") != shard_of("doc_id")).count() == 0
    assert back.drop("shard").exceptAll(docs.select(back.drop("shard").columns)).count() == 0
