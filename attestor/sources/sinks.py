"""Writers: rebuilt tables, caches, results and reports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.functions.keys import input_hash


def rebuild(tables: dict[str, DataFrame], path: str, partition_by: dict[str, str] | None = None) -> None:
    """Writes content tables anew; other tables under the path, as caches and results, stay."""
    for name, df in tables.items():
        w = df.write.mode("overwrite")
        (w.partitionBy(partition_by[name]) if partition_by and name in partition_by else w).parquet(f"{path}/{name}")


def sanitised_copy(tables: dict[str, DataFrame], path: str, leave_out: tuple[str, ...] = ("checks",)) -> None:
    rebuild({n: d for n, d in tables.items() if n not in leave_out}, path)


def result_rows(results: DataFrame, posts: DataFrame) -> DataFrame:
    """What is stored of a check: its id, the hash of the post (never the post) and the claims as JSON."""
    by = results.groupBy("post_id").agg(F.array_sort(F.collect_list(F.struct("idx", *(c for c in results.columns if c not in ("post_id", "idx"))))).alias("claims"))
    return posts.select("post_id", input_hash(F.col("text")).alias("input_hash")).join(by, "post_id", "left").select("post_id", "input_hash", F.to_json(F.struct(F.coalesce("claims", F.array()).alias("claims"))).alias("result_json"))


def cache_export(cache: DataFrame, path: str) -> None:
    """JSON lines in order of key."""
    cache.orderBy("key").write.mode("overwrite").json(path)


def predictions(preds: DataFrame, path: str) -> None:
    preds.write.mode("overwrite").json(path)


def results(config: dict, metrics: dict, path: str, spark) -> None:
    """One JSON document with the settings and the metrics of an evaluation, which results_json() reads back."""
    from pyspark.sql import Row

    text = json.dumps({"config": config, "metrics": metrics}, ensure_ascii=False, indent=1)
    spark.createDataFrame([Row(value=text)]).coalesce(1).write.mode("overwrite").option("lineSep", "\n").text(path)


def report(metrics: dict, confusion: list[dict]) -> str:
    """Markdown of the metrics, a few rows that the driver holds."""
    head = "# Evaluation\n\n| metric | value |\n|---|---|\n" + "".join(f"| {k} | {v} |\n" for k, v in metrics.items())
    if not confusion:
        return head
    cols = list(confusion[0])
    rows = "".join("| " + " | ".join(str(r[c]) for c in cols) + " |\n" for r in confusion)
    return f"{head}\n| {' | '.join(cols)} |\n|{'---|' * len(cols)}\n{rows}"
