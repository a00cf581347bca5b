"""Byte-balanced shards of indivisible groups by Karmarkar-Karp differencing."""

from __future__ import annotations

import heapq
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.llm.common import distributed_rank, read_table, slot_buckets, write_table

#: Most distinct group sizes whose table is broadcast; with more, Spark joins by a shuffle.
BROADCAST_CLASSES = 300_000


def differencing(masses: list[int], k: int) -> list[int]:
    """The part, 0 to k-1, of each item. Partial partitions wait in a heap by their spread; the two widest are
    combined with their parts in opposite order until one is left, and the parts are then traced back."""
    n = len(masses)
    if not n or k < 2:
        return [0] * n
    sums: dict[int, list[int]] = {}
    made: list[tuple[int, int, list[int]]] = []  # of node n + i: its halves and the order its parts were put in
    heap = [(-m, i) for i, m in enumerate(masses)]
    heapq.heapify(heap)
    flat = [0] * (k - 1)
    last = k - 1
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        x = sums.pop(a) if a >= n else [masses[a], *flat]
        y = sums.pop(b) if b >= n else [masses[b], *flat]
        raw = [p + q for p, q in zip(x, reversed(y))]
        order = sorted(range(k), key=raw.__getitem__, reverse=True)
        low = raw[order[last]]
        new = n + len(made)
        sums[new] = [raw[o] - low for o in order]
        made.append((a, b, order))
        heapq.heappush(heap, (low - raw[order[0]], new))
    parts: dict[int, list[int]] = {heap[0][1]: list(range(k))}
    out = [0] * n
    for i in range(len(made) - 1, -1, -1):
        mine = parts.pop(n + i)
        a, b, order = made[i]
        left, right = [0] * k, [0] * k
        for part, o in zip(mine, order):
            left[o] = part
            right[last - o] = part
        for node, own in ((a, left), (b, right)):
            if node >= n:
                parts[node] = own
            else:
                out[node] = own[0]
    if n == 1:
        out[0] = 0
    return out


def bundles(mass: int, count: int, most: int) -> list[int]:
    """Groups of one size are alike, so they are dealt in bundles: half of what is left, down to single groups, and
    never more than ``most`` bytes together if more than one."""
    out = []
    while count:
        b = max(1, min(count // 2, most // mass))
        out.append(b)
        count -= b
    return out


def deal(histogram: Iterable[tuple[int, int]], k: int) -> list[tuple[int, list[int], list[int]]]:
    """(mass, count) of the group sizes -> (mass, first rank of each bundle, its shard). The work is bounded by the
    number of distinct sizes times the logarithm of their counts, whatever the number of documents."""
    classes = sorted(histogram)
    total = sum(m * c for m, c in classes)
    items = [(i, b) for i, (m, c) in enumerate(classes) for b in bundles(m, c, total // (64 * k))]
    shards = differencing([classes[i][0] * b for i, b in items], k)
    out = [(m, [], []) for m, _ in classes]
    at = [0] * len(classes)
    for (i, b), s in zip(items, shards):
        out[i][1].append(at[i])
        out[i][2].append(s)
        at[i] += b
    return out


def shard_documents(docs: DataFrame, shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row; the law is ``bytes``.

    Rows with equal texts stay together; null and empty texts are one group of size 1 each row. Groups of equal byte
    size are interchangeable, so only the histogram of group sizes, at most one row for each distinct size, goes to
    the driver for the differencing. Slots number the rows of a shard from 0 without a gap. Repeated rows are rows of
    their own; null doc_ids keep their row; an empty table gives an empty result; other columns are ignored."""
    text = F.coalesce("text", F.lit(""))
    base = write_table(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.octet_length(text).cast("long") + 1).alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.unhex(F.sha2(text, 256)).alias("key"),
        ),
        "shard-docs",
    )
    groups = write_table(
        base.groupBy("key").agg(F.sum("size").alias("mass"), F.count(F.lit(1)).alias("n")), "shard-groups"
    )
    classes = groups.groupBy("mass").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("n")).toPandas()
    dealt = deal(zip(classes["mass"].tolist(), classes["c"].tolist()), shards)
    spark = docs.sparkSession
    table = spark.createDataFrame(dealt, "mass long, starts array<long>, shards array<int>")
    if len(dealt) <= BROADCAST_CLASSES:
        table = F.broadcast(table)
    widest = int(classes["c"].max()) if len(classes) else 0
    ranked = distributed_rank(
        groups.select("key", "mass"), ["mass"], F.pmod(F.xxhash64("key"), F.lit(slot_buckets(widest))), [F.col("key")], "rank"
    )
    place = F.size(F.filter("starts", lambda s: s <= F.col("rank")))
    keyed = write_table(ranked.join(table, "mass").select("key", F.element_at("shards", place).alias("shard")), "shard-keys")
    placed = write_table(base.join(keyed, "key").select("doc_id", "size", "text_crc32", "shard"), "shard-rows")
    rows = int(classes["n"].sum()) if len(classes) else 0
    bucket = F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(slot_buckets(rows // shards)))
    out = distributed_rank(placed, ["shard"], bucket, [F.col("doc_id"), F.col("text_crc32")], "slot")
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(read_table(spark, sf_dir, "documents"), 8)
