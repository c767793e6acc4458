"""Lineage cuts that outlive an executor.

Loops and multi-pass operators write their intermediate state as parquet under
the folder every executor shares (``spark.checkpoint.dir``).  A machine-local
folder is only ever used by a local master without that setting, as in tests; a
cluster without one raises.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a fresh local one only for a local master that names none."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("name a folder that all executors share in spark.checkpoint.dir")
        named = "file://" + tempfile.mkdtemp(prefix="fulcrum-checkpoint-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


class Workspace:
    """A private folder of written tables below the shared checkpoint folder.

    ``put`` writes and reads back, so everything downstream restarts from files
    and not from a recomputed plan.  ``drop`` frees a table that no live
    DataFrame reads.  What is left goes when the driver's JVM ends.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.root))
        self._fs.deleteOnExit(self._path(self.root))
        self._made = 0

    def put(self, df: DataFrame, label: str, by: str | None = None, **options: str) -> DataFrame:
        """The written table; with ``by`` in one folder for each value of that column, which a filter on it prunes.  ``options`` are the writer's."""
        self._made += 1
        path = f"{self.root}/{self._made:04d}-{label}"
        (df.write.partitionBy(by) if by else df.write).options(**options).parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        back._fulcrum_path = path  # type: ignore[attr-defined]
        return back

    def drop(self, df: DataFrame | None) -> None:
        path = getattr(df, "_fulcrum_path", None)
        if path:
            self._fs.delete(self._path(path), True)
