"""Changed and expired chunks of a table of sightings, and of a stream of them."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from corpusmill.streaming import freshness

START = datetime(2026, 1, 1)
SEEN = [("a", 0, "x"), ("a", 1, "x"), ("a", 2, "y"), ("a", 2, "y"), ("a", 40, "y"), ("b", 0, None), ("b", 3, None), ("b", 4, ""), ("c", 1, "z"), (None, 1, "n"), ("d", None, "t"), ("e", 29, "q"), ("e", 59, "q"), ("f", 60, "r"), ("a", 60, "y")]
SCHEMA = "url string, seen_at timestamp, content string"


def frame(spark, rows):
    return spark.createDataFrame([(u, None if d is None else START + timedelta(days=d), c) for u, d, c in rows], SCHEMA)


def told(df):
    return {((r["at"] - START).days, r["key"], r["event"], r["content_hash"][:4]) for r in df.collect()}


def brute(rows, expire=30):
    from hashlib import sha256

    h = lambda c: "-" if c is None else sha256(c.encode()).hexdigest()[:4]
    end, out = max(d for _, d, _ in rows if d is not None), set()
    for u in {u for u, _, _ in rows}:
        name = '{"url":%s}' % ("null" if u is None else f'"{u}"')
        times = sorted({(d, h(c)) for x, d, c in rows if x == u and d is not None})
        for k, (d, c) in enumerate(times):
            if k == 0 or times[k - 1][1] != c or d - times[k - 1][0] > expire:
                out.add((d, name, "changed", c))
            if min(times[k + 1][0] if k + 1 < len(times) else end, end) > d + expire:
                out.add((d + expire, name, "expired", c))
    return out


def test_a_table(spark):
    assert told(freshness.content_events(frame(spark, SEEN), key=["url"])) == brute(SEEN)
    assert freshness.content_events(frame(spark, SEEN).limit(0), key=["url"]).count() == 0


def test_a_stream_tells_the_same(spark, tmp_path):
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        df = frame(spark, SEEN)
        for low, high in ((-1, 2), (2, 29), (29, 59.5), (59.5, 99)):
            part = df.where((F.col("seen_at") > START + timedelta(days=low)) & (F.col("seen_at") <= START + timedelta(days=high)))
            part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        out = freshness.stream_content_events(stream, key=["url"], late="1 hour")
        run = out.writeStream.format("memory").queryName("fresh_out").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        run.awaitTermination(300)
        assert told(spark.table("fresh_out")) == brute(SEEN)
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old) if old else spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
