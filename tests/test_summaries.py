"""Sketches within their error, merged ones like those of all rows; typed values of JSON texts."""

import random

from pyspark.sql import functions as F

from corpusmill.functions import semi
from corpusmill.operators import sketches


def test_merged_sketches_stay_within_their_error(spark, tmp_path):
    rng = random.Random(3)
    rows = [("a" if k % 3 else None, rng.randint(0, 20_000), rng.randint(0, 10_000)) for k in range(40_000)] + [("b", None, None), ("c", 7, 5)]
    df = spark.createDataFrame(rows, "section string, item long, size int")
    of = lambda d: sketches.section_sketches(d, section="section", distinct=F.col("item"), amount=F.col("size"))
    of(df.where("coalesce(size, 0) < 3000")).write.parquet(f"file://{tmp_path}/kept")
    old = spark.read.parquet(f"file://{tmp_path}/kept")
    new = of(df.where("size >= 3000"))
    got = {r["section"]: r for r in sketches.estimates(sketches.merged(old, new), (0.1, 0.5, 0.9)).collect()}
    for s in ("a", None):
        own = [r for r in rows if r[0] == s]
        exact, sizes = len({r[1] for r in own}), sorted(r[2] for r in own)
        assert got[s]["rows"] == len(own) and abs(got[s]["distinct"] - exact) < 0.03 * exact
        for q in (10, 50, 90):
            rank = sum(x <= got[s][f"q{q}"] for x in sizes) / len(sizes)
            assert abs(rank - q / 100) < 0.03
    assert got["c"]["distinct"] == 1 and got["c"]["q50"] == 5 and got["b"]["rows"] == 1
    assert sketches.merged(of(df.limit(0))).count() == 0


def test_typed_values(spark):
    texts = ['{"a": 1, "b": {"c": "x"}}', '{"a": "one"}', '{"a": null}', "{}", "[1]", "{", "", None, '{"a": 1.5, "b": {"c": 2}}', '{"a": 99999999999999999999}', '"text"']
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id int, p string")
    got = {r["id"]: (r["a"], r["c"], r["reject"]) for r in semi.extract_typed(df, "p", {"a": ("$.a", "bigint"), "c": ("$.b.c", "string")}).collect()}
    assert got[0] == (1, "x", None) and got[1] == (None, None, "$.a is no bigint")
    assert got[2] == got[3] == got[4] == got[10] == (None, None, None) and got[7] == (None, None, None)
    assert got[5] == got[6] == (None, None, "no JSON") and got[9][2] == "$.a is no bigint"
    assert got[8][1:] == ("2", None)
    schemas = {r["id"] % 2: r["schema"] for r in semi.schema_of(df.where("id < 4").withColumn("id", F.col("id") % 2), "p", "id").collect()}
    assert schemas[0].startswith("OBJECT<") and "a" in schemas[0]
