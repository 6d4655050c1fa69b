"""Every registered query of the library against DuckDB at the smallest scale, or for its rows only."""

import duckdb
import pytest

from corpusmill.plans import registry

from .oracle import same

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, name):
    df = registry.QUERIES[name](spark, DIR)
    if name in registry.ORACLE_SQL:
        same(df, registry.ORACLE_SQL[name], DIR)
    else:
        assert df.count() > 0


def test_min_words_filter_on_odd_texts(spark, tmp_path):
    texts = [None, "", " ", "\n", "\x00", "\u00a0\u3000", "\u200b", "x", "\U0001f600 \U0001f600", "a\x85b", "w " * 99, "w " * 100, "w\u2028" * 99 + "w", " " + "é\t" * 99]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted(con.sql(registry.ORACLE_SQL["min_words_filter"]).fetchall())
    got = sorted((r["doc_id"], r["error"]) for r in registry.QUERIES["min_words_filter"](spark, str(tmp_path)).collect())
    assert got == want and got[0][1] is None and got[1][1] == "contenido demasiado corto (0 palabras < 100)"


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
