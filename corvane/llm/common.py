"""What the training-data operators share: tables, shared scratch space, ranks."""

from __future__ import annotations

import atexit
import contextlib
import gc
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: White space that separates words: U+0020 and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
#: Used only where the session names no shared folder, as in tests on one machine.
LOCAL_DIR = "file:/tmp/checkpoints"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{str(sf_dir).rstrip('/')}/{name}.parquet")


def parallelism(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds, as texts differ in length by orders of magnitude."""
    for key, value in (
        ("spark.sql.execution.arrow.maxRecordsPerBatch", "4000"),
        ("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20)),
    ):
        with contextlib.suppress(Exception):
            spark.conf.set(key, value)


class Workspace:
    """Intermediate tables in the folder that spark.checkpoint.dir names.

    Saved tables cut the lineage and survive the loss of any executor. Tables that a
    result still reads go when the driver ends; drop() removes one earlier.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not base:
            if not spark.sparkContext.master.startswith("local["):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            base = LOCAL_DIR
        self.root = f"{base.rstrip('/')}/work-{uuid.uuid4().hex}"
        atexit.register(self.drop)
        small_batches(spark)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def release(self) -> None:
        """Let Spark delete shuffle files that no frame refers to any more. It holds on
        to the last query that ran, so a trivial one takes its place first."""
        self.spark.range(1).write.format("noop").mode("overwrite").save()
        for _ in range(2):
            gc.collect()
            self.spark.sparkContext._jvm.System.gc()
            time.sleep(0.2)

    def keep(self, *names: str) -> None:
        """Drop all tables but those."""
        with contextlib.suppress(Exception):
            jvm = self.spark.sparkContext._jvm
            path = jvm.org.apache.hadoop.fs.Path(self.root)
            for file in path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path):
                if file.getPath().getName() not in names:
                    self.drop(file.getPath().getName())

    def drop(self, name: str = "") -> None:
        with contextlib.suppress(Exception):
            jvm = self.spark.sparkContext._jvm
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def clear_name(names: list[str], name: str) -> str:
    """A column name that none of `names` clashes with."""
    taken = {n.lower() for n in names}
    while f"__{name}" in taken:
        name = f"_{name}"
    return f"__{name}"


def word_count(text: str | Column) -> Column:
    """Number of words, 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(WORD)), F.lit(0)).cast("long")


def ordinal(df: DataFrame, keys: list[str], order: str, out: str, ws: Workspace, ties: list[str] = ()) -> DataFrame:
    """Add `out`, the place from 0 of each row among those with equal keys, ordered by
    the 64-bit hash column `order`, then `ties`.

    No task holds all rows of a key: a key's rows are dealt out by the top bits of the
    hash, counts per part give each part's first place, and ranks are made within parts.
    The number of parts follows the row count of the key, so parts stay small.
    """
    part = ws.save(
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("__n"))
        .withColumn("__shift", F.least(F.lit(40), F.greatest(F.lit(0), F.ceil(F.log2(F.col("__n") / 2000.0)))).cast("int"))
        .drop("__n"),
        f"{out}-shift",
    )
    a, b = df.alias("a"), part.alias("b")
    split = a.join(b, _all([F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys])).select("a.*", "b.__shift")
    split = split.withColumn("__part", F.when(F.col("__shift") == 0, F.lit(0).cast("long")).otherwise(F.expr(f"shiftrightunsigned({order}, 64 - __shift)"))).drop("__shift")
    counts = split.groupBy(*keys, "__part").agg(F.count(F.lit(1)).alias("__m"))
    first = ws.save(
        counts.withColumn("__first", F.sum("__m").over(Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))).select(*keys, "__part", F.coalesce("__first", F.lit(0)).alias("__first")).filter("__first > 0"),
        f"{out}-first",
    )
    ranked = split.withColumn("__r", F.row_number().over(Window.partitionBy(*keys, "__part").orderBy(order, *ties)))
    c, d = ranked.alias("c"), first.alias("d")
    on = _all([F.col(f"c.{k}").eqNullSafe(F.col(f"d.{k}")) for k in [*keys, "__part"]])
    return c.join(d, on, "left").select("c.*", (F.col("c.__r") - 1 + F.coalesce(F.col("d.__first"), F.lit(0))).cast("long").alias(out)).drop("__part", "__r")


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out
