"""Keyword ranking (BM25) over impact-ordered postings: what can't reach a query's best few isn't scored."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..staging import stage
from .retrieval import ranked

# The usual parameters of the ranking function.
K1, B = 1.2, 0.75
#: Terms of a query that the first pass scores at least (those that can add most, which are its rarest), and how many times k
#: documents they have together; as many of the best of these are scored by all terms.
FIRST_TERMS, FIRST_DOCUMENTS = 6, 4
#: Queries of a set at most, about.
QUERY_BLOCK = 1000
#: Sums of doubles are off by less than this.
_SLACK = 1e-9


def terms(text: Column | str) -> Column:
    """Words of a text in lower case, in order, with repeats."""
    c = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


@dataclass
class KeywordIndex:
    """postings: term, id, tf, impact, ordered by term and falling impact; lexicon: term, df, idf, most (its greatest impact).
    statistics: one row of documents and mean length."""

    postings: DataFrame
    lexicon: DataFrame
    statistics: DataFrame

    def write(self, path: str) -> None:
        for name in ("postings", "lexicon", "statistics"):
            getattr(self, name).write.parquet(f"{path}/{name}")

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> KeywordIndex:
        return cls(*(spark.read.parquet(f"{path}/{name}") for name in ("postings", "lexicon", "statistics")))


def build_index(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k1: float = K1, b: float = B) -> KeywordIndex:
    """The index of all documents, of their whole texts. A null text has no terms, but counts among the documents; rows that
    share an id are one document with the words of all.

    The impact is what a term adds to a document's score. Postings are dealt by ranges of term and impact, so that a term
    of every document fills several files, whose statistics let a search skip what is too weak.
    """
    words = docs.select(F.col(id_col).alias("id"), F.explode_outer(terms(F.coalesce(F.col(text_col).cast("string"), F.lit("")))).alias("term"))
    counts = stage(words.groupBy("term", "id").agg(F.count("term").alias("tf")), "counts")
    lengths = stage(counts.groupBy("id").agg(F.sum("tf").alias("length")), "lengths")
    statistics = stage(lengths.agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.avg("length"), F.lit(0.0)).alias("mean_length")), "statistics")
    held = counts.where("term is not null")
    frequency = held.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.ln(1 + (F.col("documents") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    lexicon = frequency.crossJoin(F.broadcast(statistics)).select("term", "df", idf.alias("idf"), "mean_length")  # one row
    lexicon = stage(lexicon, "lexicon")
    weight = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("mean_length")))
    postings = held.join(lengths, "id").join(lexicon, "term").select("term", "id", "tf", (F.col("idf") * weight).alias("impact"))
    postings = stage(postings.repartitionByRange("term", F.desc("impact"), "id").sortWithinPartitions("term", F.desc("impact"), "id"), "postings")
    most = postings.groupBy("term").agg(F.max("impact").alias("most"))
    return KeywordIndex(postings, stage(lexicon.drop("mean_length").join(most, "term"), "lexicon"), statistics)


def _scores(index: KeywordIndex, pairs: DataFrame, asked: DataFrame) -> DataFrame:
    """(query_id, id, score) of the pairs by all terms of their queries.

    A posting meets the queries that have its term and those that want its document as two sets, block by block of queries,
    and becomes a row for what they share; else it would become one for each query that wants the document.
    """
    blocks = max(1, math.ceil(asked.select("query_id").distinct().count() / QUERY_BLOCK))
    sets = lambda rows, c, name: rows.groupBy(c, F.pmod(F.xxhash64("query_id"), F.lit(blocks)).alias("block")).agg(F.collect_set("query_id").alias(name))
    wanted = index.postings.join(asked.select("term").distinct(), "term", "left_semi")
    met = wanted.join(sets(pairs, "id", "wanting"), "id").join(sets(asked, "term", "asking"), ["term", "block"])
    both = met.select(F.explode(F.array_intersect("asking", "wanting")).alias("query_id"), "id", "impact")
    return both.groupBy("query_id", "id").agg(F.sum("impact").alias("score"))


def candidates(index: KeywordIndex, queries: DataFrame, k: int, *, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(query_id, id) of the documents that may be among a query's k best, and (query_id, term) of the queries.

    A query's terms are ordered by the most that they can add. The best documents by its first few terms are scored by all
    terms, which gives a score that the k-th best surely reaches. A document whose first term in this order is t scores at most its
    impact of t and the most of all terms behind t: where that is less, the posting goes, and with rising impact the
    search of a term ends early, as its postings are in that order.
    """
    asked = queries.select("query_id", F.explode(F.array_distinct(terms(text_col))).alias("term")).join(index.lexicon, "term")
    order = Window.partitionBy("query_id").orderBy(F.desc("most"), "term")
    asked = asked.withColumns({"seen": F.sum("df").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("df"), "place": F.row_number().over(order), "rest": F.coalesce(F.sum("most").over(order.rowsBetween(1, Window.unboundedFollowing)), F.lit(0.0))})
    asked = stage(asked.select("query_id", "term", "most", "place", "seen", "rest"), "asked")
    begin = asked.where((F.col("place") <= FIRST_TERMS) | (F.col("seen") < FIRST_DOCUMENTS * k))
    first = index.postings.join(begin, "term").groupBy("query_id", "id").agg(F.sum("impact").alias("score"))
    first = stage(ranked(first, FIRST_DOCUMENTS * k).select("query_id", "id"), "first")
    reached = ranked(_scores(index, first, asked), k).groupBy("query_id").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n")).where(F.col("n") == k).select("query_id", "least")
    bounds = asked.join(reached, "query_id", "left").select("query_id", "term", "most", (F.coalesce("least", F.lit(0.0)) - F.col("rest") - _SLACK).alias("needed"))
    bounds = stage(bounds.where("most >= needed").select("query_id", "term", "needed"), "bounds")
    kept = index.postings.join(bounds, "term").where("impact >= needed").select("query_id", "id").distinct()
    return stage(kept, "candidates"), asked.select("query_id", "term")


def search(index: KeywordIndex, queries: DataFrame, k: int, *, text_col: str = "text") -> DataFrame:
    """(query_id, id, score, rank) of the k documents with the greatest BM25 score for each query, ties by id; documents
    without any of its terms aren't among them. A query is the set of its terms; one without terms gets nothing.

    Exact: only documents that can't be among the k best are left out (``candidates``). Scores are rounded to nine digits.
    """
    found, asked = candidates(index, queries, k, text_col=text_col)
    scores = _scores(index, found, asked).withColumn("score", F.round("score", 9))
    return ranked(scores, k)
