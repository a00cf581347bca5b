"""Alternatives: authentic texts of the same meaning."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attestor.config import Settings
from attestor.operators.select import first_of

AUTHENTIC = ("sahih", "hasan")


def provider_alternatives(hits: DataFrame, alternates: DataFrame, s: Settings = Settings()) -> DataFrame:
    """claim_id, text, origin, place: of the hits (claim_id, rank, record_id, has_alternate) the alternates (record_id,
    text, grade_class) that are authentic, distinct texts in order, the first few."""
    found = hits.where("has_alternate and record_id is not null").join(alternates.where(F.col("grade_class").isin(*AUTHENTIC)), "record_id")
    one = first_of(found, ["claim_id", "text"], [F.col("rank")])
    place = F.row_number().over(Window.partitionBy("claim_id").orderBy("rank"))
    return one.withColumn("place", place).where(F.col("place") <= s.max_alternatives).select("claim_id", "text", F.lit("provider_alternate").alias("origin"), "place")


def local_alternatives(candidates: DataFrame, exclude: DataFrame | None = None, s: Settings = Settings()) -> DataFrame:
    """claim_id, text, origin, place (and source, if the candidates have it): of the first 10 candidates (claim_id,
    doc_id, rank, rerank, confidence, text, grade_class) those not excluded, near enough in meaning and authentic."""
    c = candidates.where("rank <= 10")
    if exclude is not None:
        c = c.join(exclude, ["claim_id", "doc_id"], "left_anti")
    c = c.where((F.coalesce("rerank", "confidence") >= s.alternative_floor) & F.col("grade_class").isin(*AUTHENTIC))
    place = F.row_number().over(Window.partitionBy("claim_id").orderBy("rank"))
    return c.withColumn("place", place).where(F.col("place") <= s.max_alternatives).select("claim_id", "text", F.lit("local_search").alias("origin"), "place", *(x for x in ("source",) if x in c.columns))


def suggest(provider: DataFrame, local: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Provider's first, then local ones, the first few together."""
    every = provider.withColumn("o", F.lit(0)).unionByName(local.withColumn("o", F.lit(1)), allowMissingColumns=True)
    place = F.row_number().over(Window.partitionBy("claim_id").orderBy("o", "place"))
    return every.withColumn("place", place).where(F.col("place") <= s.max_alternatives).drop("o")
