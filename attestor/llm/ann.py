"""Approximate nearest neighbours by multi-index hashing over learned rotated binary codes."""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attestor.llm.common import read_table, write_table

#: Rows of the fitting sample, at most; every row is indexed.
SAMPLE = 20_000
#: Rotations, each giving one bit for each dimension.
ROTATIONS = 2
#: Share of true neighbours within the sample that the radius must cover.
COVER = 0.985
#: Sample rows that the axes and rotations are learned on, at most.
FIT = 5000
#: Rows in a block of the index, and bytes of query vectors in a block of queries: the bound of what is broadcast.
ROWS, QUERY_BYTES = 8192, 8 << 20


@dataclass
class Codes:
    """Centre and rotations of the binary codes; a code is a row of 8-bit substrings."""

    mean: np.ndarray
    turn: np.ndarray
    radius: int

    @property
    def bits(self) -> int:
        return self.turn.shape[1]

    def encode(self, x: np.ndarray) -> np.ndarray:
        return np.packbits((x - self.mean) @ self.turn >= 0, axis=1)


def _rotation(v: np.ndarray, rng: np.random.Generator, rounds: int = 30) -> np.ndarray:
    """Iterative quantisation: the rotation that brings the centred data nearest to the corners of a cube."""
    r = np.linalg.qr(rng.normal(size=(v.shape[1], v.shape[1])))[0]
    for _ in range(rounds):
        u, _, w = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
        r = (u @ w).T
    return r


def fit(sample: np.ndarray, k: int = 10, seed: int = 7) -> Codes:
    """Learns principal axes and rotations on the first FIT rows, then the radius that holds the share COVER of the k nearest neighbours of
    up to 400 sample rows. Neighbours in the whole table are nearer than those in a sample, so this is on the safe
    side. With k rows or fewer the radius takes in every code."""
    mean = sample.mean(axis=0) if len(sample) else np.zeros(sample.shape[1])
    centred = sample - mean
    rng = np.random.default_rng(seed)
    axes = np.linalg.svd(centred[:FIT], full_matrices=True)[2].T if len(sample) else np.eye(sample.shape[1])
    projected = centred[:FIT] @ axes
    turn = np.concatenate([axes @ _rotation(projected, rng) for _ in range(ROTATIONS)], axis=1)
    if turn.shape[1] % 8:
        turn = np.pad(turn, ((0, 0), (0, -turn.shape[1] % 8)))
    codes = Codes(mean, turn, turn.shape[1])
    if len(sample) > k + 1:
        code, near = codes.encode(sample), []
        for i in np.linspace(0, len(sample) - 1, min(400, len(sample))).astype(int):
            d = ((sample - sample[i]) ** 2).sum(axis=1)
            d[i] = np.inf
            best = np.argpartition(d, k)[:k]
            near.append(np.bitwise_count(code[best] ^ code[i]).sum(axis=1))
        codes.radius = int(np.quantile(np.concatenate(near), COVER, method="higher"))
    return codes


@functools.cache
def ball(radius: int) -> np.ndarray:
    """The 8-bit values within a Hamming radius of 0."""
    v = np.arange(256, dtype=np.uint8)
    return v[np.bitwise_count(v) <= radius]


class Index:
    """Multi-index over a block of rows: for each substring the rows in order of its value. It is built once, stored as
    one row of a table and read back from it."""

    PARTS = "ids binary, x binary, code binary, orders binary, starts binary"

    def __init__(self, ids: np.ndarray, x: np.ndarray, codes: Codes):
        self.ids, self.x, self.code = ids, x, codes.encode(x)
        self.orders = np.argsort(self.code, axis=0, kind="stable").T.astype(np.int32)
        self.starts = np.array([np.searchsorted(self.code[o, s], np.arange(257)) for s, o in enumerate(self.orders)])

    def stored(self) -> list[bytes]:
        kinds = (np.int64, np.float64, np.uint8, np.int32, np.int64)
        return [np.ascontiguousarray(v, k).tobytes() for v, k in zip((self.ids, self.x, self.code, self.orders, self.starts), kinds)]

    @classmethod
    def read(cls, parts: list[bytes], dim: int) -> Index:
        out = cls.__new__(cls)
        out.ids, out.x = np.frombuffer(parts[0], np.int64), np.frombuffer(parts[1], np.float64).reshape(-1, dim)
        out.code = np.frombuffer(parts[2], np.uint8).reshape(len(out.ids), -1)
        out.orders, out.starts = np.frombuffer(parts[3], np.int32).reshape(-1, len(out.ids)), np.frombuffer(parts[4], np.int64).reshape(-1, 257)
        return out

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Rows whose code differs in ``radius`` bits or fewer. Pigeonhole: with radius = m*p + a over m substrings,
        one of the first a+1 differs in p bits or fewer, or one of the others in p-1 or fewer."""
        m = self.code.shape[1]
        p, a = divmod(min(radius, 8 * m), m)
        hit = np.zeros(len(self.ids), bool)
        for s, (order, starts) in enumerate(zip(self.orders, self.starts)):
            near = p if s <= a else p - 1
            if near >= 8:
                hit[:] = True
                break
            if near >= 0:
                values = ball(near) ^ code[s]
                lo, n = starts[values], starts[values.astype(np.int64) + 1] - starts[values]
                full = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
                hit[order[full]] = True
        at = np.flatnonzero(hit)
        return at[np.bitwise_count(self.code[at] ^ code).sum(axis=1, dtype=np.int64) <= radius]


def usable(c: str) -> F.Column:
    """Not null, not zero, all components finite."""
    inf = float("inf")
    return F.coalesce(
        F.col(c).isNotNull()
        & F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < inf))
        & F.exists(c, lambda v: v != 0),
        F.lit(False),
    )


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim)


def _blocks(rows: DataFrame, first: str, most: int, made, schema: str) -> DataFrame:
    """One row, made by ``made(ids, x)``, for each ``most`` rows of a task; ``first`` names the id column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, xs, held = [], [], 0

        def out() -> pa.RecordBatch:
            i, x = np.concatenate(ids), np.concatenate(xs)
            ids[:], xs[:] = [i[most:]], [x[most:]]
            return pa.RecordBatch.from_pylist([dict(zip(names, made(i[:most], x[:most])))], pa.schema([(n, pa.binary()) for n in names]))

        names = [f.split()[0] for f in schema.split(", ")]
        for b in batches:
            if b.num_rows:
                i = b.column(0)
                ids.append((i.flatten() if pa.types.is_list(i.type) else i).to_numpy(zero_copy_only=False).reshape(b.num_rows, -1))
                xs.append(np.asarray(b.column(1).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(b.num_rows, -1))
                held += b.num_rows
            while held >= most:
                yield out()
                held -= most
        if held:
            yield out()

    return rows.select(first, "x").mapInArrow(run, schema)


def build(rows: DataFrame, codes: Codes) -> DataFrame:
    """The stored index of rows (vec_id, x): one row for each block, every row in it."""
    return write_table(_blocks(rows, "vec_id", ROWS, lambda ids, x: Index(ids, x, codes).stored(), Index.PARTS), "vector-index")


def _probe(index: DataFrame, queries: DataFrame, codes: Codes, radius: int, k: int) -> DataFrame:
    """q, vec_id, score: of each block of the index the k best candidates of each query. queries: q, vec_id, x.

    The stated queries are met with the stored index block by block: one packed block of queries, of QUERY_BYTES at
    most, is broadcast by Spark at a time. What moves is k rows for each query and block of the index."""
    dim = len(codes.mean)
    size = max(1, QUERY_BYTES // (8 * dim))
    n = queries.count()
    if not n:
        return index.sparkSession.createDataFrame([], "q long, vec_id long, score double, rank int")
    own = queries.select(F.array("q", "vec_id").alias("id"), "x")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(b.num_rows):
                *parts, q_ids, q_x = [c[at].as_py() for c in b.columns]
                block = Index.read(parts, dim)
                q_ids, q_x = np.frombuffer(q_ids, np.int64).reshape(-1, 2), np.frombuffer(q_x, np.float64).reshape(-1, dim)
                q_code, found = codes.encode(q_x), []
                for i in range(len(q_ids)):
                    near = block.within(q_code[i], radius)
                    near = near[block.ids[near] != q_ids[i, 1]]
                    if len(near):
                        score = np.sqrt(((block.x[near] - q_x[i]) ** 2).sum(axis=1))
                        best = np.lexsort((block.ids[near], score))[:k]
                        found.append((np.full(len(best), q_ids[i, 0]), block.ids[near[best]], score[best]))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], ["q", "vec_id", "score"])

    packed = write_table(
        _blocks(own.repartition(-(-n // size)), "id", size, lambda ids, x: [np.ascontiguousarray(ids).tobytes(), np.ascontiguousarray(x).tobytes()], "q_ids binary, q_x binary")
        .withColumn("block", F.monotonically_increasing_id()), "query-blocks",
    )
    out = []
    for r in packed.select("block").collect():  # numbers of blocks only
        one = packed.where(F.col("block") == r.block).drop("block")
        found = index.crossJoin(F.broadcast(one)).mapInArrow(run, "q long, vec_id long, score double")
        out.append(write_table(_ranked(found, k), "neighbours"))
    return functools.reduce(DataFrame.unionByName, out)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("q").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def neighbours(vectors: DataFrame, is_query: F.Column, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found of each query, nearest first, ties to the smaller id.

    A query row that is repeated is one query; rows with the same id and different vectors are a query each. A row whose
    id is the query's is its own and no candidate. Null, zero and non-finite vectors, those of another length than most
    of the sample's, and rows without an id take no part. Queries that find fewer than k rows within the learned radius
    are searched again over all codes, so only tables with fewer candidates give fewer. Repeated rows are all
    candidates; an empty table gives an empty result; other columns are ignored."""
    spark = vectors.sparkSession
    rows = vectors.where(usable("embedding") & F.col("vec_id").isNotNull()).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x")
    )
    total = rows.count()
    share = min(1.0, 1.2 * SAMPLE / max(1, total))
    sample = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(1_000_003)) < int(share * 1_000_003) + 1).limit(SAMPLE).select("x").toPandas()["x"]
    if not len(sample):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = int(sample.map(len).mode()[0])
    codes = fit(np.array([x for x in sample if len(x) == dim], np.float64).reshape(-1, dim), k)
    rows = rows.where(F.size("x") == dim)
    asked = rows.where(is_query).distinct().withColumn("q", F.monotonically_increasing_id())
    queries = write_table(asked, "vector-queries")
    index = build(rows, codes)
    found = _probe(index, queries, codes, codes.radius, k)
    if codes.radius < codes.bits:
        few = queries.join(found.where(F.col("rank") == k).select("q"), "q", "left_anti")
        rest = write_table(few, "few-neighbours")
        again = _probe(index, rest, codes, codes.bits, k)
        found = found.join(rest.select("q"), "q", "left_anti").unionByName(again)
    return found.join(queries.select("q", F.col("vec_id").alias("query_id")), "q").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
