"""Tables of a run in a folder that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import uuid

from pyspark.sql import DataFrame, SparkSession


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds: ten thousand rows, Spark's own bound, of texts'
    features are hundreds of megabytes."""
    for key, value in (("spark.sql.execution.arrow.maxRecordsPerBatch", "4000"), ("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))):
        with contextlib.suppress(Exception):
            spark.conf.set(key, value)


class Folder:
    """Tables of a run, which cut the lineage; a whole one is read and not made again.
    Without a given root the folder is a new one below spark.checkpoint.dir, and goes when
    the driver ends."""

    def __init__(self, spark: SparkSession, root: str | None):
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not (root or base) and not spark.sparkContext.master.startswith("local["):
            raise ValueError("give a folder, or name one in spark.checkpoint.dir, that all executors share")
        self.spark, self.root = spark, root or f"{(base or 'file:/tmp/checkpoints').rstrip('/')}/run-{uuid.uuid4().hex}"
        small_batches(spark)
        if root is None:
            atexit.register(self.drop)

    def table(self, name: str, make=None) -> DataFrame:
        path = f"{self.root}/{name}"
        jvm = self.spark.sparkContext._jvm
        mark = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        if make and not mark.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(mark):
            make().write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.parquet(path)

    def drop(self, name: str = "") -> None:
        with contextlib.suppress(Exception):
            jvm = self.spark.sparkContext._jvm
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
