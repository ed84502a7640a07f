"""A table of values by key whose files are bucketed by the key.

Rows to look up are dealt into the same buckets, and the join with the store then reads
each bucket where it lies: however large the store is, it is never shuffled. New rows are
appended to their buckets; compaction writes each bucket as one sorted file again, into
a new folder, and the table changes over to it when that is complete.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class _Place:
    table: str
    folder: str


class KeyedStore:
    """``schema`` holds the key, a column ``key`` without repeated values, and the values."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str, buckets: int, version: str) -> None:
        self.spark, self.path, self.schema, self.key, self.buckets = spark, path, schema, key, buckets
        self._place = self._register(version)

    @classmethod
    def create(cls, spark: SparkSession, path: str, schema: str, key: str, buckets: int | None = None) -> KeyedStore:
        """An empty store below ``path``. Its buckets are the session's shuffle partitions
        unless given; they should hold what a task can sort."""
        return cls(spark, path, schema, key, buckets or int(spark.conf.get("spark.sql.shuffle.partitions")), uuid.uuid4().hex)

    @classmethod
    def open(cls, spark: SparkSession, path: str, schema: str, key: str, buckets: int, version: str) -> KeyedStore:
        """A store that another session has written, by its ``version``."""
        return cls(spark, path, schema, key, buckets, version)

    @property
    def version(self) -> str:
        return self._place.folder.rsplit("/", 1)[1]

    def _register(self, version: str) -> _Place:
        place = _Place(f"keyed_{uuid.uuid4().hex}", f"{self.path}/{version}")
        self.spark.sql(
            f"CREATE TABLE {place.table} ({self.schema}) USING parquet"
            f" CLUSTERED BY ({self.key}) SORTED BY ({self.key}) INTO {self.buckets} BUCKETS LOCATION '{place.folder}'"
        )
        return place

    def rows(self) -> DataFrame:
        return self.spark.table(self._place.table)

    def dealt(self, df: DataFrame) -> DataFrame:
        """``df`` in the buckets of the store; a join on the key needs no other shuffle."""
        return df.repartition(self.buckets, self.key)

    def _write(self, df: DataFrame, place: _Place) -> None:
        names = self.rows().columns
        # One file for each bucket that has rows, not one for each task and bucket.
        df.select(*names).repartition(self.buckets, self.key).write.insertInto(place.table)

    def append(self, fresh: DataFrame) -> None:
        """Adds rows whose keys the store does not have."""
        self._write(fresh, self._place)

    def compact(self) -> None:
        """Writes the store anew with one file a bucket, and changes over to it."""
        new = self._register(uuid.uuid4().hex)
        # Read as plain files, so that Spark does deal them out once more.
        plain = self.spark.read.schema(self.rows().schema).parquet(self._place.folder)
        self._write(plain, new)
        old, self._place = self._place, new
        self.spark.sql(f"DROP TABLE {old.table}")  # forgets the name; its files stay for open readers
