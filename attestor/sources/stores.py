"""Stores: vectors by collection, posts that are never written, stored results, probes that are asked now and then."""

from __future__ import annotations

import threading
import time
from collections import OrderedDict
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.operators.dense import dense_topk, embed, index_missing


class VectorStore:
    """Collections of unit vectors (doc_id, vec), each a folder of Parquet files under one path."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _folder(self, name: str):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def read(self, name: str) -> DataFrame | None:
        """The collection, or None where nothing was added yet. A build that was stopped leaves whole batches only."""
        path, fs = self._folder(name)
        batches = [s.getPath().toString() for s in fs.listStatus(path)] if fs.exists(path) else []
        done = [b for b in batches if self._whole(fs, b)]
        return self.spark.read.parquet(*done) if done else None

    def _whole(self, fs, batch: str) -> bool:
        return fs.exists(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{batch}/_SUCCESS"))

    def add(self, name: str, rows: DataFrame, encoder: Callable[[list[str]], list[list[float]]], limit: int | None = None) -> int:
        """Embeds the rows (doc_id, text) that the collection lacks and appends them; returns how many. Run again after
        a stop it goes on with what is missing. ``limit`` bounds the rows of one call."""
        new = index_missing(rows.select("doc_id", "text").dropDuplicates(["doc_id"]), self.read(name))
        new = new if limit is None else new.orderBy("doc_id").limit(limit)
        batch = f"{self.path}/{name}/batch={time.time_ns()}"
        embed(new, F.col("text"), encoder).select("doc_id", "vec").write.parquet(batch)
        return self.spark.read.schema(f"doc_id {new.schema['doc_id'].dataType.simpleString()}, vec array<double>").parquet(batch).count()

    def counts(self, names: list[str]) -> dict[str, int]:
        return {n: (df.count() if (df := self.read(n)) is not None else 0) for n in names}

    def query(self, name: str, queries: DataFrame, k: int) -> DataFrame:
        """query_id, doc_id, sim, rank; an empty collection gives no rows."""
        vectors = self.read(name)
        if vectors is None:
            return self.spark.createDataFrame([], f"query_id {dict(queries.dtypes)['query_id']}, doc_id string, sim double, rank int")
        return dense_topk(queries, vectors.select("doc_id", "vec"), k)


class PostStore:
    """Posts by check, in memory only and the last ``most`` of them: a result can be prepared without a post being kept."""

    def __init__(self, most: int = 500):
        self.most, self.posts, self.lock = most, OrderedDict(), threading.Lock()

    def remember(self, check_id: str, text: str) -> None:
        with self.lock:
            self.posts[check_id] = text
            while len(self.posts) > self.most:
                self.posts.popitem(last=False)

    def recall(self, check_id: str) -> str | None:
        return self.posts.get(check_id)


class Probe:
    """Answer of a check that is asked again after ``ttl`` seconds only; a check that fails counts as False."""

    def __init__(self, ask: Callable[[], bool], ttl: float = 300.0, clock=time.monotonic):
        self.ask, self.ttl, self.clock, self.at, self.last = ask, ttl, clock, float("-inf"), False

    def __call__(self) -> bool:
        if self.clock() - self.at >= self.ttl:
            try:
                self.last = bool(self.ask())
            except Exception:  # the service is not to be reached
                self.last = False
            self.at = self.clock()
        return self.last


def stored_result(results: DataFrame, post_id) -> dict | None:
    """The row of result_rows() of one post, or None."""
    found = results.where(F.col("post_id") == post_id).limit(1).collect()
    return found[0].asDict(recursive=True) if found else None
