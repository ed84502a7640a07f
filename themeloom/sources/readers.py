"""Scans. CSV columns are read as strings and converted by the adapters, so a
scan never makes an inference pass over the data."""

from __future__ import annotations

from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _csv(spark: SparkSession, multi_line: bool) -> DataFrameReader:
    return (
        spark.read.option("header", True)
        .option("multiLine", multi_line)
        .option("escape", '"')
        .option("recursiveFileLookup", True)
    )


def csv_header(spark: SparkSession, path: str, multi_line: bool = True) -> list[str]:
    """Column names, from the header of one file (nested folders included)."""
    return _csv(spark, multi_line).csv(path).columns


def read_csv(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """CSV with quoted line breaks; adds ``_file`` (name of the source file).

    All files must have the same header: Spark compares each with the first and
    fails on another name or order, so no column is ever read as another one. Files
    of different layouts are read apart and united by the adapters. ``multi_line``
    files cannot be split, so very large exports should be written as many files or
    read with ``multi_line=False``.
    """
    names = csv_header(spark, path, multi_line)
    schema = T.StructType([T.StructField(name, T.StringType()) for name in names])
    return (
        _csv(spark, multi_line).schema(schema)
        .option("enforceSchema", False)
        .csv(path)
        .withColumn("_file", F.col("_metadata.file_name"))
    )


def list_files(spark: SparkSession, root: str, glob: str = "*.csv") -> DataFrame:
    """(file_name, file_size) below ``root``, largest first; reads no content."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", glob)
        .load(root)
        .select(
            F.element_at(F.split("path", "/"), -1).alias("file_name"),
            F.col("length").alias("file_size"),
        )
        .orderBy(F.desc("file_size"), "file_name")
    )


def folder_sizes(spark: SparkSession, root: str, glob: str = "*.csv") -> DataFrame:
    """(folder, n_files, n_bytes) of the folders below ``root`` that hold files, largest
    first: an export of many part files counts as one. Reads no content."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    )
    folder = F.regexp_replace("path", "/[^/]*$", "").alias("folder")
    return files.groupBy(folder).agg(F.count("*").alias("n_files"), F.sum("length").alias("n_bytes")).orderBy(
        F.desc("n_bytes"), "folder"
    )


def spread(df: DataFrame, key: str | None = None) -> DataFrame:
    """Deals rows out when a scan has fewer partitions than the cluster has cores.

    Large tables already have more and are left alone. With ``key`` rows are dealt as a
    join on that column deals them, which then need not move them again.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores) if key is None else df.repartition(key)


def read_corpus(spark: SparkSession, path: str, workspace: str | None = None) -> DataFrame:
    """The persisted corpus; a workspace name prunes to its partition."""
    df = spark.read.parquet(path)
    return df if workspace is None else df.filter(F.col("workspace") == workspace)


def read_insights(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_records(spark: SparkSession, path: str, schema: T.StructType, broken: str = "_broken") -> DataFrame:
    """JSON lines by an explicit schema. A line that is no such record gives a row of
    nulls with the line itself in the column ``broken``."""
    whole = T.StructType([*schema.fields, T.StructField(broken, T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": broken}
    rows = spark.read.schema(whole).options(**options).json(path)
    # What was parsed before the break is not a record.
    return rows.select(*[F.when(F.col(broken).isNull(), F.col(c)).alias(c) for c in schema.names], broken)
