"""A corpus preparation pipeline over ``documents``: each stage's result is written as Parquet and read as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import exact_dedup, language_id, mixing, near_dedup, packing
from corpusmill.llm.common import read_table
from corpusmill.staging import new_path, scratch


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model can tell. A text that is null, empty or without a letter is rejected; a very long
    one is read to its end; rows with null ids and repeated rows stay; without any row to learn from, nothing is told and
    all go; an empty table gives an empty result; other columns stay as they are."""
    return language_id.identified_only(docs, language_id.fit(docs, ~language_id.held_out()))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts stays: that with the largest id, or one without an id if none has any.

    Rows that repeat an id and text are one row; rows that share an id but differ in text are told apart by its digest. A
    null text counts as empty; a text of any length is hashed whole; an empty table gives an empty result; other columns
    are those of the row that stays.
    """
    kept = exact_dedup.exact_dedup(docs, exact_dedup.batch_rule()).select(F.col("keep_id").alias("_keep"), F.col("text_sha256").alias("_kept_sha")).distinct()
    rows = docs.withColumn("_sha", F.lower(F.hex(exact_dedup.sha256(F.coalesce("text", F.lit("")))))).dropDuplicates(["doc_id", "_sha"])
    return rows.join(kept.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_keep")) & (F.col("_sha") == F.col("_kept_sha")), "left_semi").select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near duplicates stays: that with the least id, and of several with that id the one whose
    text has the least digest. A row with a null id is a class of its own.

    Rows are told apart by id and digest, so that no text goes of which no near copy stays. Null and empty texts are one
    class; texts of any length are compared whole; an empty table gives an empty result; other columns stay as they are.
    """
    kept = near_dedup.near_dedup(docs).where("kept and doc_id is not null").select(F.col("doc_id").alias("_near_id"), F.col("text_sha256").alias("_near_sha")).distinct()
    same = (docs["doc_id"] == F.col("_near_id")) & (F.sha2(F.coalesce(docs["text"], F.lit("")), 256) == F.col("_near_sha"))
    return docs.join(kept.hint("merge"), same, "left_semi").union(docs.where("doc_id is null"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice.

    The mix takes rows of one id (or without one) and one source alike, unless they have no words: null and empty texts
    go. Texts are taken whole, however long; ties of the hash go together; an empty table gives an empty result.
    """
    times = mixing.mix(docs, with_source=True).where("taken > 0").select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.expr("cast(taken / size as int)").alias("_times")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("source").cast("string").eqNullSafe(F.col("_source"))
    return docs.where(F.col("text").rlike(r"[^\x20\x09-\x0D]")).join(times.hint("merge"), same).withColumn("_copy", F.explode(F.sequence(F.lit(1), "_times"))).select(docs.columns)


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences; odd rows as ``packing.pack`` says."""
    return packing.pack(docs)


STAGES = [
    ("language ID", keep_known_language),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_documents),
]

#: Language models, sketches and token ids have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages. What a stage has staged for itself is removed once its result is written."""
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, step) in enumerate(STAGES[:-1]):
        path = new_path(spark, f"pipeline-{k}")
        with scratch(spark):
            made = step(spark, docs, sf_dir)
            made.write.parquet(path)
        docs = spark.read.schema(made.schema).parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
