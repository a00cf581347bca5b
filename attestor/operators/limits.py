"""Sliding-window admission, in batch."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


class Budget:
    """The times admitted within the window so far, at most ``limit`` of them."""

    def __init__(self, limit: int, window: float):
        self.limit, self.window, self.held = limit, window, deque()

    def admit(self, t: float) -> bool:
        while self.held and t - self.held[0] > self.window:
            self.held.popleft()
        ok = self.limit <= 0 or len(self.held) < self.limit
        if ok and self.limit > 0:
            self.held.append(t)
        return ok


def admit_times(times: list[float], limit: int, window: float) -> list[bool]:
    """In order: a request is admitted if fewer than ``limit`` admitted ones lie within the window; those older than
    it are forgotten; rejected ones don't count. A limit of 0 or less admits all."""
    budget = Budget(limit, window)
    return [budget.admit(t) for t in times]


def admit(requests: DataFrame, key: str, at: str, order: str, limit: int, window: float, out: str = "admitted") -> DataFrame:
    """Adds ``out`` to every request. The decision for a request depends on all before it of its key, so each key is
    one ordered run; keys are spread over the tasks, and what a task holds of a key is its budget, never its history.
    ``at``: seconds as a number; ``order`` breaks ties. A null key is a key; null times come first and are admitted."""
    names = [c for c in requests.columns if c != out]
    rows = requests.select(*(F.col(f"`{c}`") for c in names))
    where, when = names.index(key), names.index(at)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, budget = object(), None
        for b in batches:
            ok = []
            for k, t in zip(b.column(where).to_pylist(), b.column(when).to_pylist()):
                if budget is None or k != last:
                    last, budget = k, Budget(limit, window)
                ok.append(t is None or budget.admit(t))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ok, pa.bool_())], [*names, out])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), f"`{out}` boolean"])
    return rows.repartition(key).sortWithinPartitions(key, at, order).mapInArrow(run, schema)


def _bursts(requests: DataFrame, at: str, window: float) -> DataFrame:
    """Adds __burst: requests with a whole empty span of the window's length between them are in different ones, so no
    budget reaches from one into the other. Only the distinct spans, not the requests, are brought into one order."""
    span = F.floor(F.col(at) / F.lit(float(window))) if window > 0 else F.lit(0)
    marked = requests.withColumn("__span", span)
    spans = marked.select("__span").distinct()
    w = Window.orderBy("__span")
    new = (F.col("__span") - F.lag("__span").over(w) > 1).cast("int")
    numbered = spans.select("__span", F.coalesce(F.sum(new).over(w), F.lit(0)).alias("__burst")) if window > 0 else spans.withColumn("__burst", F.lit(0).cast("long"))
    return marked.join(numbered, marked["__span"].eqNullSafe(numbered["__span"])).drop("__span")


def admit_both(requests: DataFrame, key: str, at: str, order: str, own: tuple[int, float], shared: tuple[int, float]) -> DataFrame:
    """Visitor budget, then a budget for all: ``own_ok`` and ``admitted``. A visitor's slot is used even where the
    shared budget then denies. Only requests that the first admits reach the shared one, which is a key for each burst
    of requests: bursts are apart by more than its window."""
    first = admit(requests, key, at, order, *own, out="own_ok")
    passed = admit(_bursts(first.where("own_ok"), at, shared[1]), "__burst", at, order, *shared).drop("__burst")
    return passed.unionByName(first.where("not own_ok").withColumn("admitted", F.lit(False)))
