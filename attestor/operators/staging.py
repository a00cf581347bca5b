"""Intermediate tables in the cluster's shared folder: they cut long plans and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset a temporary one, in local mode only: on a cluster the
    executors would each write to a disk of their own."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="attestor-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


_staged: list[tuple[str, str]] = []


def staged(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Writes ``df`` to the shared folder and returns the table read back. It stays until release(), or for good where
    ``keep`` is true (an index that later calls read)."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/staged/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not keep:
        _staged.append((spark.sparkContext.applicationId, path))
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Deletes the tables that this session's calls have staged, and returns how many. To be called once their results
    are written: results are read from such tables."""
    mine = [x for x in _staged if x[0] == spark.sparkContext.applicationId]
    jvm = spark.sparkContext._jvm
    for x in mine:
        path = jvm.org.apache.hadoop.fs.Path(x[1])
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        _staged.remove(x)
    return len(mine)


def spread(df: DataFrame) -> DataFrame:
    """A table of fewer partitions than there are cores is dealt over all of them, so that costly expressions on it
    don't run in one task; a table of more is left as it is, so nothing large is moved."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
