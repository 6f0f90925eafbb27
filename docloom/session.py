"""Session settings and shared-storage helpers used by every operator."""

from __future__ import annotations

import atexit
import gc
import tempfile
import time
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_ROOT = str(Path(__file__).resolve().parent.parent)


def prepare(spark: SparkSession) -> SparkSession:
    """Makes this package importable in Python workers and keeps Arrow batches
    small, so that a batch of very long texts still fits in a worker."""
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(":")
    if _ROOT not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = ":".join([_ROOT, *filter(None, paths)])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a temporary
    folder where that is unset (local mode)."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="docloom-")
        spark.sparkContext._conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Scratch:
    """Tables that one query writes to the shared folder to cut its lineage.

    ``drop`` removes a table that nothing reads any more; what is left goes when
    the driver ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.paths: dict[int, str] = {}
        atexit.register(self._end)

    def path(self, tag: str) -> str:
        return f"{self.root}/{tag}-{uuid.uuid4().hex[:8]}"

    def keep(self, df: DataFrame, tag: str) -> DataFrame:
        path = self.path(tag)
        df.write.parquet(path)
        kept = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(kept)] = path
        return kept

    def drop(self, *kept: DataFrame) -> None:
        for df in kept:
            if path := self.paths.pop(id(df), None):
                self._delete(path)

    def release(self) -> None:
        """Lets Spark delete the shuffle files of steps that have been written: it
        does so when the driver collects garbage, which a large heap puts off."""
        for _ in range(2):  # what the first round sets free may hold more; files go a little later
            gc.collect()
            self.spark.sparkContext._jvm.System.gc()
            time.sleep(0.3)

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)

    def _end(self) -> None:
        if self.spark.sparkContext._jsc is not None and not self.spark.sparkContext._jsc.sc().isStopped():
            self._delete(self.root)
