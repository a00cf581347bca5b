"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.llm.common import Written


def _step(edges: Written, large: bool) -> Written:
    """One star step. Minima are pre-aggregated and written, so the join that follows reads two plain tables and
    Spark can split a node with very many neighbours."""
    e = edges.df
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else e
    least = Written(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")), "star-min")
    joined = both.join(least.df, "a")
    if large:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select("a", F.col("m").alias("b")).unionByName(
            joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        )
    written = Written(out.distinct(), "star-edges")
    least.drop()
    return written


def connected_components(edges: DataFrame) -> Written:
    """``edges`` (a, b long) -> written table (a, b): b is the smallest node that a reaches. Self loops and repeats are
    allowed; nodes without another neighbour and the smallest nodes themselves are not in it. An empty table gives an
    empty result. The steps go on until nothing changes, which takes some log^2 of the nodes."""
    now = Written(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        "edges",
    )
    mark = None
    while True:
        seen = now.df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == mark or not seen[0]:
            return now
        mark = seen
        wide = _step(now, True)
        now.drop()
        now = _step(wide, False)
        wide.drop()
