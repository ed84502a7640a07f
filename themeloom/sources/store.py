"""A store of named datasets with a manifest that is replaced as a whole.

Datasets are written to folders of their own, never over each other. A manifest, one
small table with a row for each dataset, says which folder is the current one. A write
ends by renaming a complete new manifest to the next number, which fails if another
writer has taken that number; then the rows are put into the newer manifest and the
rename is tried again. Readers take the manifest with the highest number, so they see all
of a write or nothing of it, and a write that fails leaves the old datasets readable.
Listing reads the manifest only. The rename has to be atomic, as on HDFS and local disks.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "dataset string, path string, n_rows long, version long"
TRIES = 20


@dataclass(frozen=True)
class DatasetStore:
    spark: SparkSession
    root: str

    def _files(self):
        """Spark's own view of the file system that holds the store."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        return path.getFileSystem(conf), jvm.org.apache.hadoop.fs.Path

    def _version(self) -> int:
        files, path = self._files()
        folder = path(f"{self.root}/manifest")
        if not files.exists(folder):
            return 0
        names = [x.getPath().getName() for x in files.listStatus(folder)]
        return max([int(x) for x in names if x.isdigit()], default=0)

    def _manifest(self, version: int) -> DataFrame:
        if version == 0:
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifest/{version}")

    def datasets(self) -> DataFrame:
        """dataset, path, n_rows, version of each current dataset."""
        return self._manifest(self._version()).orderBy("dataset")

    def write(self, df: DataFrame, name: Column) -> None:
        """Replaces each dataset that occurs in ``name`` by its rows; others stay. All
        rows are written in one job, and a null name is left out."""
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        named = df.withColumn("_dataset", name.cast("string")).filter("_dataset IS NOT NULL")
        named.write.partitionBy("_dataset").parquet(folder)
        written = self.spark.read.schema(named.schema).option("basePath", folder).parquet(folder)
        fresh = written.groupBy(F.col("_dataset").alias("dataset")).agg(
            F.count("*").alias("n_rows"), F.max(F.regexp_replace(F.col("_metadata.file_path"), "/[^/]*$", "")).alias("path")
        )
        self._commit(fresh)

    def drop(self, names: list[str]) -> None:
        none = self.spark.createDataFrame([(n, None, 0) for n in names], "dataset string, path string, n_rows long")
        self._commit(none)

    def _commit(self, fresh: DataFrame) -> None:
        files, path = self._files()
        for _ in range(TRIES):
            known = self._version()
            number = F.lit(known + 1).cast("long").alias("version")
            kept = self._manifest(known).join(fresh, "dataset", "left_anti")
            rows = kept.unionByName(fresh.filter("path IS NOT NULL").select("dataset", "path", "n_rows", number))
            draft = f"{self.root}/manifest/.draft-{uuid.uuid4().hex}"
            rows.coalesce(1).write.parquet(draft)  # a row for each dataset
            if files.rename(path(draft), path(f"{self.root}/manifest/{known + 1}")) and not files.exists(path(f"{self.root}/manifest/{known + 1}/{draft.rsplit('/', 1)[1]}")):
                return
        raise RuntimeError(f"{self.root}: other writers were faster {TRIES} times")

    def read(self, *names: str) -> DataFrame:
        """The rows of datasets, all if none is named, with the name as ``dataset``."""
        current = self.datasets() if not names else self.datasets().filter(F.col("dataset").isin(*names))
        rows = current.collect()  # a row for each dataset that is read
        missing = set(names) - {r.dataset for r in rows}
        if missing or not rows:
            raise KeyError(f"no dataset {', '.join(sorted(missing)) or 'at all'} in {self.root}")
        out = None
        for r in rows:
            part = self.spark.read.parquet(r.path).withColumn("dataset", F.lit(r.dataset))
            out = part if out is None else out.unionByName(part, allowMissingColumns=True)
        return out
