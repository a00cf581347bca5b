"""Streaming forms: verification of arriving posts, admission limits, latest-wins upserts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from attestor.operators.limits import admit_times
from attestor.plans.verify import Corpus, verify


def verify_stream(posts: DataFrame, corpus: Corpus, path: str, checkpoint: str):
    """Verifies each micro-batch of posts and appends the results; a batch that is run again replaces its own."""

    def write(batch: DataFrame, number: int) -> None:
        verify(batch, corpus).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return posts.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()


def admit_stream(requests: DataFrame, key: str, limit: int, window: float, idle: str = "1 hour") -> DataFrame:
    """key, ts, admitted for requests (key, ts timestamp): the state of a key is its admitted times within the window,
    at most ``limit``; it is dropped once the key was idle and the watermark has passed."""

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = list(state.get[0]) if state.exists else []
        rows = pd.concat(batches).sort_values("ts", kind="stable")
        times = [t.timestamp() for t in rows["ts"]]
        admitted = admit_times([*held, *times], limit, window)[len(held) :]
        held = [t for t in [*held, *(t for t, ok in zip(times, admitted) if ok)] if times and times[-1] - t <= window]
        state.update((held,))
        state.setTimeoutTimestamp(int(max([*times, state.getCurrentWatermarkMs() / 1000 + 1]) * 1000 + window * 1000) + 1)
        yield pd.DataFrame({key: [k[0]] * len(rows), "ts": rows["ts"], "admitted": admitted})

    kind = dict(requests.dtypes)[key]
    return (
        requests.select(key, "ts").withWatermark("ts", idle).groupBy(key)
        .applyInPandasWithState(run, f"{key} {kind}, ts timestamp, admitted boolean", "held array<double>", "append", GroupStateTimeout.EventTimeTimeout)
    )


def latest_stream(changes: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Latest row of each key so far (update or complete mode)."""
    rest = [c for c in changes.columns if c not in keys]
    return changes.groupBy(*keys).agg(F.max_by(F.struct(*rest), at).alias("r")).select(*keys, "r.*")
