"""Helpers shared by the operators: table access, written intermediate tables, distributed ranks."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Rows and bytes of an Arrow batch, at most, where the session has not set its own: texts may be long, and each task
#: holds some batches in the JVM and in Python.
BATCH_ROWS, BATCH_BYTES = 2000, 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Sets the size of Arrow batches, unless it was set before."""
    for name, default, value in (("maxRecordsPerBatch", "10000", BATCH_ROWS), ("maxBytesPerBatch", "67108864b", BATCH_BYTES)):
        if spark.conf.get(f"spark.sql.execution.arrow.{name}", default) == default:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(value))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where that is unset a temporary one, in local mode only: on a cluster the
    executors would each write to a disk of their own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="attestor-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


class Written:
    """An intermediate table written to the shared folder: cuts lineage and survives lost executors."""

    def __init__(self, df: DataFrame, name: str):
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark)}/attestor-tables/{name}-{uuid.uuid4().hex}"
        self.schema = df.schema
        df.write.parquet(self.path)

    @property
    def df(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def drop(self) -> None:
        """Removes the files; call it only when no later plan reads them."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def write_table(df: DataFrame, name: str) -> DataFrame:
    return Written(df, name).df


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of so many rows, views of the same buffers: what Python makes of a piece stays small. When
    they end, memory that is free goes back to the system, as workers live on with other tasks."""
    try:
        for b in batches:
            for at in range(0, b.num_rows, rows):
                yield b.slice(at, rows)
    finally:
        give_back()


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # the C library of Linux has it
        trim(0)


def slot_buckets(rows: int, per_bucket: int = 4096, most: int = 65536) -> int:
    """Number of buckets of a distributed rank: grows with the rows up to a fixed size of the offset table."""
    return max(1, min(most, -(-rows // per_bucket)))


def distributed_rank(df: DataFrame, by: list[str], bucket: Column, order: list[Column], out: str) -> DataFrame:
    """Gapless rank from 0 within each ``by`` group without one task seeing a whole group.

    ``df`` must be stable (a written table): it is read twice. Rows are ranked within (by, bucket); the offsets of
    the buckets are running sums over the table of counts, one row for each (by, bucket)."""
    b = f"__{out}_bucket"
    df = df.withColumn(b, bucket)
    counts = df.groupBy(*by, b).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*by).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*by, b, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    local = df.withColumn("__local", F.row_number().over(Window.partitionBy(*by, b).orderBy(*order)))
    return (
        local.join(offsets, [*by, b])
        .withColumn(out, (F.col("__offset") + F.col("__local") - 1).cast("long"))
        .drop(b, "__local", "__offset")
    )
