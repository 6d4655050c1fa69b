"""The chunk store: idempotent upserts, orphan removal, sections in directories of their own, a log of versions."""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..staging import stage

KEY = ["doc_url", "chunk_index"]
#: Columns that an update replaces; id and created_at stay.
UPDATED = ["doc_title", "section", "heading_path", "content", "embedding", "token_count", "metadata"]
COLUMNS = ["id", *KEY, *UPDATED, "created_at"]
SCHEMA = "id long, doc_url string, chunk_index int, doc_title string, section string, heading_path string, content string, embedding array<float>, token_count int, metadata string, created_at timestamp"


def last_per_key(incoming: DataFrame, key: list[str] = KEY, order: str = "pos") -> DataFrame:
    """Of rows with one key, the last in input order, with ``_times`` rows seen. Rows of one place go by their content."""
    cols = [c for c in incoming.columns if c not in key]
    same = Window.partitionBy(*key)
    last = same.orderBy(F.desc(order), F.desc(F.xxhash64(*[c for c in cols if c != order])))
    # (Windows sort whole rows once, behind the shuffle; an aggregate of whole rows sorts them on both sides of it.)
    rows = incoming.withColumns({"_place": F.row_number().over(last), "_times": F.count(F.lit(1)).over(same)})
    return rows.where("_place = 1").select(*key, *cols, "_times")


def upsert(existing: DataFrame, incoming: DataFrame, *, key: list[str] = KEY, updated: list[str] = UPDATED, now: object = None, order: str = "pos", top: int | None = None) -> DataFrame:
    """The store after an upsert, each row with its ``action``: created, updated or kept.

    New keys get ids after ``top``, or the greatest one of ``existing``, in an order of documents and then by index. An
    update keeps id and created_at. One full outer join on the key, whose result is staged, as numbering reads it again.
    """
    now = F.current_timestamp() if now is None else now
    new = last_per_key(incoming, key, order).select(*key, *[F.col(c).alias(f"_n_{c}") for c in updated], "_times")
    both = existing.withColumn("_old", F.lit(True)).join(new, key, "full")
    is_new, is_update = F.col("_old").isNull(), F.col("_old").isNotNull() & F.col("_times").isNotNull()
    cols = [F.when(is_new | is_update, F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c) for c in updated]
    created_at = F.coalesce("created_at", F.when(is_new, now)).alias("created_at")
    action = F.when(is_new, "created").when(is_update, "updated").otherwise("kept").alias("action")
    rows = both.select("id", *key, *cols, created_at, action, F.coalesce("_times", F.lit(0)).alias("times"))
    return number_created(stage(rows, "merged"), key, top)


def number_created(rows: DataFrame, key: list[str], top: int | None = None) -> DataFrame:
    """Gives created rows ids after the greatest one: documents are few beside chunks, so documents are counted first.
    Rows are dealt by document, as orphan removal needs them too."""
    if top is None:
        top = rows.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    made = rows.where("action = 'created'")
    per_doc = made.groupBy(key[0]).agg(F.count(F.lit(1)).alias("_n"))
    # Ranges of documents, 4096 at most: the running sum is over one row a range, then within a range.
    ranged = per_doc.withColumn("_range", F.substring(F.md5(F.col(key[0]).cast("binary")), 1, 3))
    starts = ranged.groupBy("_range").agg(F.sum("_n").alias("_s")).selectExpr("_range", "sum(_s) over (order by _range) - _s as _before")
    within = ranged.selectExpr("*", f"sum(_n) over (partition by _range order by {key[0]} rows between unbounded preceding and current row) - _n as _inside")
    first = within.join(F.broadcast(starts), "_range").select(F.col(key[0]).alias("_d"), (F.col("_before") + F.col("_inside")).alias("_first"))
    numbered = rows.selectExpr("*", f"count_if(action = 'created') over (partition by {key[0]} order by {key[1]} rows between unbounded preceding and current row) as _k").join(first, F.col(key[0]) == F.col("_d"), "left")
    new_id = F.when(F.col("action") == "created", F.lit(top) + F.col("_first") + F.col("_k")).otherwise(F.col("id"))
    return numbered.withColumn("id", new_id).select(*rows.columns)


def delete_orphans(store: DataFrame, incoming: DataFrame, *, key: list[str] = KEY) -> DataFrame:
    """Rows of the store with ``orphan``: of a document seen in this run, an index at or above its number of incoming
    rows. Repeated keys count as often as they came; documents that gave nothing this time are not cleaned."""
    n = incoming.groupBy(F.col(key[0]).alias("_d")).agg(F.count(F.lit(1)).alias("_n"))
    over = F.coalesce(F.col(key[1]) >= F.col("_n"), F.lit(False))
    return store.join(n, F.col(key[0]) == F.col("_d"), "left").withColumn("orphan", over).drop("_d", "_n")


def upsert_counters(existing: DataFrame, incoming: DataFrame, *, key: list[str] = KEY) -> DataFrame:
    """One row: chunks created, updated and deleted by an upsert with orphan removal, counted from keys alone.

    A key that came twice counts as one created and one updated row.
    """
    new = incoming.groupBy(*key).agg(F.count(F.lit(1)).alias("_times"))
    both = existing.select(*key, F.lit(True).alias("_old")).join(new, key, "full")
    marked = delete_orphans(both, incoming.select(*key), key=key)
    updated = F.when(F.col("_old").isNull(), F.col("_times") - 1).otherwise(F.coalesce("_times", F.lit(0)))
    return marked.agg(
        F.count_if(F.col("_old").isNull()).alias("chunks_created"),
        F.coalesce(F.sum(updated), F.lit(0)).alias("chunks_updated"),
        F.count_if("orphan").alias("chunks_deleted"),
    )


def merge(existing: DataFrame, incoming: DataFrame, *, now: object = None, top: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(the store after upsert and orphan removal, one row of counters); contents are staged once, counters need none."""
    marked = delete_orphans(upsert(existing, incoming, now=now, top=top), incoming)
    return marked.where("not orphan").select(*existing.columns), upsert_counters(existing, incoming)


def ensure_schema(spark: SparkSession, table: str, schema: str = SCHEMA) -> None:
    """Creates a catalog table for chunks if there is none; done twice it changes nothing."""
    spark.sql(f"create table if not exists {table} ({schema}) using parquet partitioned by (section)")


class ConcurrentWrite(RuntimeError):
    """Another writer has finished a version since this one began; nothing was changed."""


class VersionedStore:
    """A table of chunks, a directory a section, and a log of versions.

    A version is a file that names the directory of each section and the greatest id. It is written under another name
    and then moved to its number, which fails if the number is taken: a failed or second writer changes nothing, and
    readers see whole versions only. An upsert rewrites the sections that it touches and names the others' old ones.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str = SCHEMA):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def _hadoop(self):
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        log = jvm.org.apache.hadoop.fs.Path(f"{self.path}/log")
        return jvm, conf, log, log.getFileSystem(conf)

    def _head(self) -> tuple[int, dict]:
        _, _, log, fs = self._hadoop()
        names = [f.getPath().getName() for f in fs.listStatus(log)] if fs.exists(log) else []
        numbers = [int(n.removesuffix(".json")) for n in names if n.removesuffix(".json").isdigit()]
        if not numbers:
            return 0, {"top": 0, "sections": {}}
        text = self.spark.read.text(f"{self.path}/log/{max(numbers):012d}.json", wholetext=True).first()[0]
        return max(numbers), json.loads(text)

    def _commit(self, number: int, head: dict) -> None:
        jvm, conf, log, fs = self._hadoop()
        path = lambda name: jvm.org.apache.hadoop.fs.Path(log, name)
        draft = path(f".draft-{uuid.uuid4().hex}")
        out = fs.create(draft)
        out.write(bytearray(json.dumps(head).encode()))
        out.close()
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf).rename(fs.makeQualified(draft), fs.makeQualified(path(f"{number:012d}.json")), none)
        except Py4JJavaError as e:
            fs.delete(draft, False)
            if "FileAlreadyExists" in str(e.java_exception):
                raise ConcurrentWrite(f"version {number} was written by another") from None
            raise

    def version(self) -> int:
        return self._head()[0]

    def _read(self, dirs: list[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*dirs) if dirs else self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        return self._read(sorted(self._head()[1]["sections"].values()))

    def _write(self, df: DataFrame) -> dict[str, str]:
        """Writes each section to a directory of its own; gives the directories by the section's digest."""
        _, conf, log, fs = self._hadoop()
        base = f"{self.path}/data/{uuid.uuid4().hex}"
        df.withColumn("part", _digest(F.col("section"))).write.partitionBy("part").parquet(base)
        names = [f.getPath().getName() for f in fs.listStatus(log.getParent().suffix(base.removeprefix(self.path)))]
        return {n.removeprefix("part="): f"{base}/{n}" for n in names if n.startswith("part=")}

    def write(self, df: DataFrame) -> int:
        """Replaces the whole table."""
        number, _ = self._head()
        top = df.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
        self._commit(number + 1, {"top": top, "sections": self._write(df)})
        return number + 1

    def upsert(self, incoming: DataFrame) -> dict[str, int]:
        """Counters of the upsert. Sections are touched if an incoming row, or a stored row of an incoming document, is in
        them; their names are all that reaches the driver."""
        number, head = self._head()
        stored = self.read().join(incoming.select(KEY[0]).distinct(), KEY[0], "left_semi")
        names = incoming.select("section").union(stored.select("section")).select(_digest(F.col("section"))).distinct()
        touched = {r[0] for r in names.collect()}
        existing = self._read([d for k, d in sorted(head["sections"].items()) if k in touched])
        after, counters = merge(existing.select(*COLUMNS), incoming, top=head["top"])
        counted = counters.first().asDict()
        made = self._write(after)
        sections = {k: d for k, d in head["sections"].items() if k not in touched} | made
        self._commit(number + 1, {"top": head["top"] + counted["chunks_created"], "sections": sections})
        return counted

    def healthy(self) -> bool:
        """Whether the stored table has the columns and types of the schema (an empty store has)."""
        want = {f.name: f.dataType for f in self.spark.createDataFrame([], self.schema).schema}
        dirs = self._head()[1]["sections"].values()
        return all({f.name: f.dataType for f in self.spark.read.parquet(d).schema} == want for d in dirs)


def _digest(section):
    return F.md5(F.coalesce(section, F.lit("")).cast("binary"))
