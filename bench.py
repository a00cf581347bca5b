"""Times the building of the lexical index, which is stored once, and the headline queries: BENCH_SF_DIR (default sf0.1) on local[BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import tempfile
import time

QUERIES = [
    "norm_text", "term_freq", "bm25_topk", "bm25_topk_filtered", "dense_topk", "rrf_fuse", "phrase_exact", "stream_matches", "token_overlap", "grade_bucket", "grade_aggregate",
    "alternatives_top2", "html_blocks", "dedupe_first", "upsert_latest", "pk_lookup", "fk_collect", "verbatim_exists", "eval_by_category", "classify_pairs", "verify_e2e",
]


def main() -> None:
    from pyspark.sql import SparkSession

    from attestor.plans.queries import QUERIES as registered
    from attestor.plans.queries import Tables

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    with tempfile.TemporaryDirectory() as shared:
        spark = (
            SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "16g").config("spark.ui.enabled", "false")
            .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", f"file://{shared}").getOrCreate()
        )
        spark.sparkContext.setLogLevel("ERROR")
        began = time.time()
        Tables(spark, sf_dir).index()
        took = {"index_build": round(time.time() - began, 3)}
        for name in QUERIES:
            began = time.time()
            registered[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took[name] = round(time.time() - began, 3)
        spark.stop()
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
