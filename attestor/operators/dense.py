"""Dense retrieval over unit vectors, with pluggable encoders."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestor.operators.staging import staged


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two arrays in double precision; null for zero vectors."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def unit(v: Column) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: x.cast("double") / norm)


#: Rows of a packed block of vectors, and bytes of a packed block of queries: the bound of what is broadcast.
ROWS, QUERY_BYTES = 4096, 8 << 20


def _packed(df: DataFrame, id_: str, most: int) -> DataFrame:
    """ids (array) and x (the vectors as doubles, packed) of each ``most`` rows of a task; ``df``: id_, vec."""
    kind = df.schema[id_].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, most):
                part = b.slice(at, most)
                x = np.asarray(part.column(1).flatten().to_numpy(zero_copy_only=False), np.float64)
                ids = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(0))
                yield pa.RecordBatch.from_arrays([ids, pa.array([x.tobytes()], pa.binary())], ["ids", "x"])

    rows = df.select(id_, F.col("vec").cast("array<double>").alias("vec"))
    return rows.mapInArrow(run, f"ids array<{kind.simpleString()}>, x binary")


def _usable(df: DataFrame) -> DataFrame:
    return df.where("vec is not null and forall(vec, v -> v is not null and not isnan(v)) and exists(vec, v -> v <> 0)")


def dense_topk(queries: DataFrame, vectors: DataFrame, k: int = 50, list_name: str = "list") -> DataFrame:
    """query_id, doc_id, sim, rank. queries: (query_id, vec); vectors: (doc_id, vec, and a ``list`` column where a
    document is in several). Per document the best similarity over its lists counts; ties go to the smaller id. Null and
    zero vectors, and those of another length than the query's, have no similarity and are left out.

    The stated queries meet the vectors in packed blocks: one block of queries, of QUERY_BYTES at most, is broadcast at
    a time and multiplied with each block of vectors; k rows for each query and block move on, not the product."""
    lists = 1
    if list_name in vectors.columns:
        lists = vectors.select(list_name).distinct().count()  # a document has a row for each list at most
    q, v = staged(_usable(queries.select("query_id", "vec")), "queries"), _usable(vectors.select("doc_id", "vec"))
    most, q_kind, d_kind = k * max(1, lists), q.schema["query_id"].dataType, v.schema["doc_id"].dataType
    schema = f"query_id {q_kind.simpleString()}, doc_id {d_kind.simpleString()}, sim double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(b.num_rows):
                ids, x, dim, q_ids, q_x = (b.column(i)[at] for i in range(5))
                dim = dim.as_py()
                x, q_x = (np.frombuffer(m.as_py(), np.float64).reshape(-1, dim) for m in (x, q_x))
                sims = (q_x / np.linalg.norm(q_x, axis=1, keepdims=True)) @ (x / np.linalg.norm(x, axis=1, keepdims=True)).T
                if sims.shape[1] > most:  # all that tie with the last one kept go on: the ids decide later
                    edge = np.partition(sims, -most, axis=1)[:, -most][:, None]
                    rows, cols = np.nonzero(sims >= edge - 1e-12)
                else:
                    rows, cols = np.divmod(np.arange(sims.size), sims.shape[1])
                yield pa.RecordBatch.from_arrays([q_ids.values.take(pa.array(rows)), ids.values.take(pa.array(cols)), pa.array(sims[rows, cols])], ["query_id", "doc_id", "sim"])

    dims = q.groupBy(F.size("vec")).count().collect()  # lengths of the queries: one, as a rule
    found = []
    for dim, n in dims:
        size = max(1, QUERY_BYTES // (8 * dim))
        asked = q.where(F.size("vec") == dim)
        blocks = staged(_packed(asked.repartition(-(-n // size)), "query_id", size).select(F.col("ids").alias("q_ids"), F.col("x").alias("q_x")).withColumn("block", F.monotonically_increasing_id()), "query-blocks")
        rows = _packed(v.where(F.size("vec") == dim), "doc_id", ROWS).withColumn("dim", F.lit(dim))
        for r in blocks.select("block").collect():  # numbers of blocks only
            one = blocks.where(F.col("block") == r.block).drop("block")
            found.append(rows.crossJoin(F.broadcast(one)).mapInArrow(run, schema))
    pairs = reduce(DataFrame.unionByName, found) if found else queries.sparkSession.createDataFrame([], schema)
    if lists > 1:
        pairs = pairs.groupBy("query_id", "doc_id").agg(F.max("sim").alias("sim"))
    # products in another order differ in the last places, so ties are of 12 places
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("sim", 12)), "doc_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k)


def embed(df: DataFrame, text: Column, encoder: Callable[[list[str]], list[list[float]]], out: str = "vec", batch: int = 16) -> DataFrame:
    """Adds unit vectors by an encoder that is given lists of texts; it is made once for each worker by its closure."""

    @F.pandas_udf("array<double>")
    def run(s: pd.Series) -> pd.Series:
        texts = s.fillna("").tolist()
        vecs = [v for at in range(0, len(texts), batch) for v in encoder(texts[at : at + batch])]
        rows = np.asarray(vecs, np.float64).reshape(len(texts), -1)
        return pd.Series(list(rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-300)))

    return df.withColumn(out, run(text))


def index_missing(rows: DataFrame, existing: DataFrame | None, doc_id: str = "doc_id") -> DataFrame:
    """Rows whose id isn't indexed yet: embed and append only these, so a stopped build goes on where it was."""
    return rows if existing is None else rows.join(existing.select(doc_id), doc_id, "left_anti")
