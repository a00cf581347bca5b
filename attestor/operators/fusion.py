"""Reciprocal rank fusion, reranking and confidence."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rrf_fuse(lists: dict[str, DataFrame], k: int = 60, top: int | None = 20) -> DataFrame:
    """query_id, doc_id, rrf, ranks (map of list to rank), rank. Each list has query_id, doc_id, rank (from 1).

    Ties keep the order of the lists and of the ranks in them."""
    tagged = [df.select("query_id", "doc_id", F.lit(n).alias("list"), F.lit(i).alias("priority"), "rank") for i, (n, df) in enumerate(lists.items())]
    every = reduce(DataFrame.unionByName, tagged)
    fused = every.groupBy("query_id", "doc_id").agg(
        F.sum(1.0 / (k + F.col("rank"))).alias("rrf"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("list", "rank")))).alias("ranks"),
        F.min(F.struct("priority", "rank")).alias("first"),
    )
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("rrf", 12)), "first", "doc_id")
    out = fused.withColumn("rank", F.row_number().over(w)).drop("first")
    return out if top is None else out.where(F.col("rank") <= top)


def confidence(rerank: Column, rrf: Column, k: int = 60) -> Column:
    return F.coalesce(rerank, F.least(F.lit(1.0), rrf * (k / 2)))


def rerank(candidates: DataFrame, query: str, doc: str, scorer: Callable[[list[str], list[str]], list[float]], head: int = 10, keep: int | None = 5) -> DataFrame:
    """Scores the first ``head`` of each query (logits, made 0 to 1), puts them in order of it, the rest after them in
    the order they had. Only the head reaches Python."""

    @F.pandas_udf("double")
    def score(q: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series(scorer(q.tolist(), d.fillna("").tolist()), dtype=float)

    # 450 characters are what the scorer reads of a text
    first = candidates.where(F.col("rank") <= head).withColumn("rerank", 1 / (1 + F.exp(-score(F.col(query), F.substring(doc, 1, 450)))))
    rest = candidates.where(F.col("rank") > head).withColumn("rerank", F.lit(None).cast("double"))
    w = Window.partitionBy("query_id").orderBy(F.col("rerank").isNull(), F.desc("rerank"), "rank")
    out = first.unionByName(rest).withColumn("rank", F.row_number().over(w))
    return out if keep is None else out.where(F.col("rank") <= keep)


def weak(candidates: DataFrame, queries: DataFrame, low: float = 0.5) -> DataFrame:
    """query_id, weak: no candidate, or a best one of low confidence."""
    best = candidates.where("rank = 1").select("query_id", "confidence")
    return queries.select("query_id").join(best, "query_id", "left").select("query_id", F.coalesce(F.col("confidence") < low, F.lit(True)).alias("weak"))
