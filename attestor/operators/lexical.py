"""BM25 over a postings table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestor.functions.text import tokens
from attestor.operators.staging import spread, staged

K1, B = 1.2, 0.75


@dataclass
class LexicalIndex:
    """postings (term, doc_id, tf, dl), one row for each term of a document, stats (n_docs, avgdl), one row, and of a stored
    index words (doc_id, words), the documents' words in order, and terms (term, n), how many documents hold each."""

    postings: DataFrame
    stats: DataFrame
    words: DataFrame | None = None
    terms: DataFrame | None = None

    @classmethod
    def build(cls, docs: DataFrame, doc_id: str, words: Column) -> LexicalIndex:
        """``words``: array of index terms. Documents without words count in the statistics. Nothing is computed yet:
        write() or stored() does it once."""
        d = spread(docs).select(F.col(doc_id).alias("doc_id"), F.coalesce(words, F.array().cast("array<string>")).alias("w"))
        postings = d.select("doc_id", F.size("w").alias("dl"), F.explode("w").alias("term")).groupBy("term", "doc_id").agg(
            F.count(F.lit(1)).alias("tf"), F.first("dl").alias("dl")
        )
        stats = d.agg(F.count(F.lit(1)).alias("n_docs"), F.avg(F.size("w").cast("double")).alias("avgdl"))
        return cls(postings, stats)

    @classmethod
    def stored(cls, docs: DataFrame, doc_id: str, words: Column) -> LexicalIndex:
        """The index in the shared folder: each text is normalised once, into a table of its words, and whatever asks the
        index reads postings in order of their terms, so that the files and pages of other terms are passed over."""
        d = staged(spread(docs).select(F.col(doc_id).alias("doc_id"), F.coalesce(words, F.array().cast("array<string>")).alias("words")), "words", keep=True)
        built = cls.build(d, "doc_id", F.col("words"))
        postings = staged(built.postings.sortWithinPartitions("term"), "postings", keep=True)
        terms = staged(postings.groupBy("term").agg(F.count(F.lit(1)).alias("n")), "terms", keep=True)
        return cls(postings, staged(built.stats, "stats", keep=True), d, terms)

    def write(self, path: str) -> LexicalIndex:
        self.postings.repartition("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/postings")
        self.stats.write.mode("overwrite").parquet(f"{path}/stats")
        return self.read(self.postings.sparkSession, path)

    @classmethod
    def read(cls, spark, path: str) -> LexicalIndex:
        return cls(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/stats"))


def query_terms(words: Column, most: int = 40) -> Column:
    """Distinct words in the order they first come, the first 40."""
    return F.slice(F.array_distinct(words), 1, most)


def bm25(index: LexicalIndex, queries: DataFrame, query_id: str, words: Column, k: int = 50, allowed: DataFrame | None = None, most_terms: int = 40) -> DataFrame:
    """query_id, doc_id, score, rank: the k best documents of each query; score is negative, best first, ties by doc_id.

    Statistics are those of the whole index; ``allowed`` (query_id, doc_id) or (doc_id) restricts the documents before
    the limit. The query terms meet the postings on the term, so only postings of query terms are shuffled; document
    frequencies are those of a stored index or else counted among the same postings."""
    q = queries.select(F.col(query_id).alias("query_id"), F.explode(query_terms(words, most_terms)).alias("term"))
    used = index.postings.join(q.select("term").distinct(), "term", "left_semi")
    df = used.groupBy("term").agg(F.count(F.lit(1)).alias("n")) if index.terms is None else index.terms.join(q.select("term").distinct(), "term", "left_semi")
    idf = F.greatest(F.log((F.col("n_docs") - F.col("n") + 0.5) / (F.col("n") + 0.5)), F.lit(1e-6))
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    weighted = df.crossJoin(F.broadcast(index.stats)).select("term", "avgdl", idf.alias("idf"))  # one row of statistics
    hits = q.join(weighted, "term").join(used, "term")
    if allowed is not None:
        hits = hits.join(allowed, [c for c in ("query_id", "doc_id") if c in allowed.columns], "left_semi")
    scored = hits.groupBy("query_id", "doc_id").agg((-F.sum(part)).alias("score"))
    # sums in another order differ in the last places, so ties are of 9 places
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("score", 9), "doc_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def words_of(c: Column) -> Column:
    return tokens(c)
