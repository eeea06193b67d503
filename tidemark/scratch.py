"""Intermediate tables in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

MAX_GROUP_ROWS = 2_000_000


def scratch_root(spark: SparkSession) -> str:
    """Shared folder named by ``spark.checkpoint.dir``; a local one only in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, label: str) -> str:
    app = spark.sparkContext.applicationId
    return f"{scratch_root(spark)}/tidemark/{app}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Cuts the lineage, survives lost executors and keeps column pruning and
    filter pushdown for whatever reads the table next.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.partitionBy(*partition_by or []).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def max_group_rows(spark: SparkSession, override: int | None = None) -> int:
    """Largest number of rows one window group may put into a single task."""
    if override is not None:
        return override
    return int(spark.conf.get("spark.tidemark.maxGroupRows", str(MAX_GROUP_ROWS)))


def spread(df: DataFrame) -> DataFrame:
    """Give an input of fewer partitions than cores one partition per core.

    Large inputs already have more splits than cores and pass unchanged.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def width(spark: SparkSession) -> int:
    """Partitions for costly per-row work: what the session shuffles into, one per core at least."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def cache_bytes(spark: SparkSession) -> int:
    """Memory that the executors have for kept rows and for work; the driver counts in local mode only."""
    status = spark.sparkContext._jsc.sc().getExecutorMemoryStatus().valuesIterator()
    sizes = []
    while status.hasNext():
        sizes.append(status.next()._1())
    driver = 0 if len(sizes) == 1 else min(sizes)
    return sum(sizes) - driver


def balance(df: DataFrame, keys: list[str]) -> DataFrame:
    """Spread a small per-series table over the shuffle's width before costly per-row work.

    Adaptive execution would otherwise merge it into a few partitions by size.
    """
    return df.repartition(width(df.sparkSession), *keys)


def clear(spark: SparkSession) -> None:
    """Delete this application's intermediate tables; call it when its results have been read."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{scratch_root(spark)}/tidemark/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
