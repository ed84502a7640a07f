"""Session defaults and the one way this package cuts lineage.

``stage`` writes a frame to the shared checkpoint folder and reads it back.
A written table survives the loss of any executor, is column-pruned when it is
read again, and has a known size, so Spark's own broadcast threshold decides
from a measured number whether a join side is small enough to broadcast.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.compression.codec": "snappy",
}


def local_session(cores: str | int = "*", partitions: int = 8, **extra: str) -> SparkSession:
    """A local session for tests and the benchmark; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("themeloom")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(partitions))
    )
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder the cluster names; a temporary one only in local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="themeloom-")
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir()


def task_count(spark: SparkSession, n_rows: int, rows_per_task: int) -> int:
    """Partitions for compute-heavy blocks that are few bytes: adaptive coalescing
    would undo their split, so the number is fixed, between the core count and the
    session's shuffle partitions."""
    most = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cores = spark.sparkContext.defaultParallelism
    return max(1, min(most, max(cores, n_rows // rows_per_task)))


def stage(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` to the shared folder and return the frame that reads it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stage_counting(df: DataFrame, label: str = "stage", **metrics: Column) -> tuple[DataFrame, dict]:
    """``stage``, and aggregates of the rows that it writes, gathered while it writes.

    They are observed behind the last shuffle, in the tasks that write, each of which
    counts once however often it is tried.
    """
    seen = Observation(label)
    written = stage(df.observe(seen, *[m.alias(name) for name, m in metrics.items()]), label)
    return written, seen.get
