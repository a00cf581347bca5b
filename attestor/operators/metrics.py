"""Evaluation metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestor.functions.keys import parse_ref

STATUSES = ("green", "amber", "red")


def rate(ok: Column) -> Column:
    """Mean of a boolean, nulls left out, 4 places; null for no rows."""
    return F.bround(F.avg(ok.cast("double")), 4)


def token_overlap(a: Column, b: Column) -> Column:
    """Share of the second's distinct words that the first has."""
    return F.size(F.array_intersect(a, b)) / F.greatest(F.lit(1), F.size(F.array_distinct(b)))


def same_source(pred: Column, expected: Column) -> Column:
    """The predicted id is expected, or its range of passages lies around an expected range (``ayah:`` ids)."""
    def inside(e: Column) -> Column:
        p, x = parse_ref(F.substr(pred, F.lit(6))), parse_ref(F.substr(e, F.lit(6)))
        low = (p["chapter"] < x["chapter"]) | ((p["chapter"] == x["chapter"]) & (p["first"] <= x["first"]))
        high = (p["chapter_end"] > x["chapter_end"]) | ((p["chapter_end"] == x["chapter_end"]) & (p["last"] >= x["last"]))
        return e.startswith("ayah:") & pred.startswith("ayah:") & low & high

    return F.coalesce(F.array_contains(expected, pred) | F.exists(expected, inside), F.lit(False))


def rates(preds: DataFrame, by: list[str] | None = None) -> DataFrame:
    """n, extraction_recall, top1, top5, status_acc, match_acc; overall or by category."""
    src = F.size("expected_source_ids") > 0
    aggs = [
        F.count(F.lit(1)).alias("n"), rate(F.col("extracted")).alias("extraction_recall"),
        rate(F.when(src, F.col("top1"))).alias("top1"), rate(F.when(src, F.col("top5"))).alias("top5"),
        rate(F.coalesce(F.col("status") == F.col("expected_status"), F.lit(False))).alias("status_acc"),
        rate(F.when(F.col("expected_match").isNotNull(), F.coalesce(F.col("match_type") == F.col("expected_match"), F.lit(False)))).alias("match_acc"),
    ]
    return preds.groupBy(*(by or [])).agg(*aggs)


def confusion(df: DataFrame, expected: str = "expected_status", got: str = "status", values: tuple[str, ...] = STATUSES) -> DataFrame:
    """One row for each expected value, one column for each value got and ``none``, zero-filled."""
    spark = df.sparkSession
    counts = df.groupBy(expected).agg(*(F.count(F.when(F.coalesce(got, F.lit("none")) == v, 1)).alias(v) for v in (*values, "none")))
    return spark.createDataFrame([(v,) for v in values], f"{expected} string").join(counts, expected, "left").fillna(0)


def latency(df: DataFrame, ms: str = "ms") -> DataFrame:
    """median, p90 (the value at int(0.9 n) - 1 of the sorted ones), max. Values are counted first, so what is sorted
    is bounded by the distinct values."""
    counts = df.where(F.col(ms).isNotNull()).groupBy(F.col(ms).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    hist = counts.agg(F.array_sort(F.collect_list(F.struct("v", "c"))).alias("h"), F.sum("c").alias("n"), F.max("v").alias("max"))
    upto = F.aggregate("h", F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("double").alias("v")), lambda s, x: F.struct((s["seen"] + x["c"]).alias("seen"), F.when((s["seen"] < F.greatest(F.floor(F.col("n") * 0.9), F.lit(1))) & (s["seen"] + x["c"] >= F.greatest(F.floor(F.col("n") * 0.9), F.lit(1))), x["v"].cast("double")).otherwise(s["v"]).alias("v")))
    middle = df.agg(F.percentile(F.col(ms), F.lit(0.5)).alias("median"))
    return middle.crossJoin(hist.select(upto["v"].alias("p90"), F.col("max").cast("double").alias("max")))
