"""Lookups: texts to cached responses, vectors to texts, across languages, and plain retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.config import Settings
from attestor.operators import fusion
from attestor.operators.dense import dense_topk
from attestor.operators.select import first_of


def cached_items(cache: DataFrame) -> DataFrame:
    """key, text: each distinct text of each cached response."""
    return cache.select("key", F.explode("response.text").alias("text")).where("text is not null").distinct()


def cached_response(texts: DataFrame, cache: DataFrame, text: str = "text", endpoint: str = "search") -> DataFrame:
    """texts with ``key``: the first cached response of an end point (by key) that holds the text; null if none does.

    The texts meet the cached items by equality, so no response is searched as a string."""
    items = cached_items(cache.where(F.col("key").startswith(f"{endpoint}:"))).groupBy(F.col("text").alias("__text")).agg(F.min("key").alias("key"))
    return texts.join(items, texts[text] == F.col("__text"), "left").drop("__text")


def cross_lingual(claims: DataFrame, vectors: DataFrame, texts: DataFrame, cache: DataFrame, scorer=None, k: int = 8, s: Settings = Settings()) -> DataFrame:
    """claim_id, text, score, query: for claims (claim_id, text, vec) in one language the cached text in another that
    comes nearest in meaning, and the query whose cached response holds it.

    The first k texts by cosine (vectors: doc_id, vec) are scored by the scorer or, without one, by the cosine; the best
    must reach the bound of a paraphrase. texts: doc_id, text."""
    near = dense_topk(claims.select(F.col("claim_id").alias("query_id"), "vec"), vectors, k).join(texts.select("doc_id", "text"), "doc_id")
    if scorer is None:
        scored = near.withColumn("score", F.col("sim"))
    else:
        asked = near.join(claims.select(F.col("claim_id").alias("query_id"), F.col("text").alias("q")), "query_id")
        scored = fusion.rerank(asked, "q", "text", scorer, k, None).withColumn("score", F.col("rerank"))
    best = first_of(scored.where(F.col("score") >= s.cross_paraphrase), ["query_id"], [F.desc("score"), F.desc("text")])
    found = cached_response(best.select(F.col("query_id").alias("claim_id"), "text", "score"), cache)
    return found.select("claim_id", "text", "score", F.coalesce(F.expr("substring(key, instr(key, ':') + 1)"), "text").alias("query"))


def best_by(df: DataFrame, keys: list[str], value: str, out: list[str]) -> DataFrame:
    """For each key the columns ``out`` of the row with the greatest value; of equal ones the least of ``out``."""
    return first_of(df.where(F.col(value).isNotNull()), keys, [F.desc(value), *out]).select(*keys, *out, value)


def ordered_column(table: DataFrame, column: str, allowed: tuple[str, ...], keys: tuple[str, ...] = ("id",), offset: int = 0, limit: int | None = None) -> DataFrame:
    """The keys and one column, of those allowed, in order of the keys; a page of it if a limit is given."""
    if column not in allowed:
        raise ValueError(f"{column!r} is none of {', '.join(allowed)}")
    rows = table.select(*keys, column).orderBy(*keys)
    rows = rows.offset(offset) if offset else rows
    return rows if limit is None else rows.limit(limit)
