"""Interval joins against nested loops, and pairs of events in batch and across two streams."""

from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from corpusmill.operators.intervals import interval_join
from corpusmill.streaming.joins import followed_by

START = datetime(2026, 1, 1)


def at(hours):
    return None if hours is None else START + timedelta(hours=hours)


LEFT = [(1, 0, 5), (1, 5, 5), (1, 6, 700), (1, None, 3), (1, 9, 8), (None, 0, 9), (2, -50, 2), (2, 0, 0), (2, 0, 0)] + [(3, k, k + 30) for k in range(0, 400, 7)]
RIGHT = [(1, 5, 6), (1, 4, None), (1, 0, 4), (None, 0, 9), (2, 2, 3), (2, 0, 0), (2, 0, 0), (4, 0, 1), (1, 650, 800)] + [(3, k, k + k % 50) for k in range(300)]


@pytest.mark.parametrize("on, part", [(["k"], 2000), (["k"], 3), ([], 10)])
def test_interval_join(spark, on, part):
    frame = lambda rows, n: spark.createDataFrame([(k, i, at(s), at(e)) for i, (k, s, e) in enumerate(rows)], f"k int, {n}id int, {n}s timestamp, {n}e timestamp")
    a, b = frame(LEFT, "l"), frame(RIGHT, "r")
    a = a if on else a.drop("k")
    b = b if on else b.drop("k")
    out = interval_join(a, b, on=on, left_ends=("ls", "le"), right_ends=("rs", "re"), width="1 day", part=part)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    ok = lambda s, e: s is not None and e is not None and s <= e
    want = Counter((i, j) for i, (k, s, e) in enumerate(LEFT) for j, (m, u, v) in enumerate(RIGHT) if (not on or (k is not None and k == m)) and ok(s, e) and ok(u, v) and s <= v and u <= e)
    assert Counter((r["lid"], r["rid"]) for r in out.collect()) == want
    assert interval_join(a.limit(0), b, on=on, left_ends=("ls", "le"), right_ends=("rs", "re")).count() == 0


def test_keys_with_few_intervals_are_shuffled_once(spark):
    """However many buckets their intervals touch; no row is dealt again for the counts of buckets and parts."""
    rows = [(k % 50, k, at(k), at(k + 90000)) for k in range(1000)]
    a, b = (spark.createDataFrame(rows, f"k int, {n}id int, {n}s timestamp, {n}e timestamp") for n in "lr")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = interval_join(a, b, on=["k"], left_ends=("ls", "le"), right_ends=("rs", "re"), width="1 day")
        assert out.count() == 50 * 20 * 20
        assert out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange hashpartitioning") == 2
        few = interval_join(a, b, on=["k"], left_ends=("ls", "le"), right_ends=("rs", "re"), width="900 days", few=3, part=7)
        assert sorted(few.collect()) == sorted(out.collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_pairs_across_two_streams_are_those_of_a_batch(spark, tmp_path):
    schema = "user_id int, event_id int, ts timestamp"
    first = [(1, 1, at(0)), (1, 2, at(0.5)), (2, 3, at(0)), (None, 4, at(0)), (1, 5, at(30)), (3, 6, None)]
    then = [(1, 11, at(0.5)), (1, 12, at(1)), (1, 13, at(1.01)), (2, 14, at(-0.1)), (None, 15, at(0)), (1, 16, at(30)), (1, 17, at(31))]
    a, b = spark.createDataFrame(first, schema), spark.createDataFrame(then, schema)
    want = {(1, 1, 11), (1, 1, 12), (1, 2, 11), (1, 2, 12), (1, 2, 13), (1, 5, 16), (1, 5, 17)}
    key = lambda df: {(r["user_id"], r["first_id"], r["then_id"]) for r in df.collect()}
    assert key(followed_by(a, b)) == want
    for name, df in (("a", a), ("b", b)):
        newer = spark.createDataFrame([(7, 70, at(40))], schema).where(F.lit(name == "a"))  # a row without a partner
        for part in (df.where(F.col("ts") < at(20)), df.where(F.col("ts") >= at(20)), newer):
            part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}")
        # Comes a day behind the newest of its side.
        spark.createDataFrame([(1, 90, at(0.2))], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}")
    sides = [spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{n}") for n in ("a", "b")]
    run = followed_by(*sides, late="2 hours").writeStream.format("memory").queryName("pairs_out").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    run.awaitTermination(240)
    assert key(spark.table("pairs_out")) == want
