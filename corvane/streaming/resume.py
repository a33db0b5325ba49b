"""Incremental scoring: only rows whose key is not yet in the output are scored.

`score_new` looks into the output; `score_once` keeps what it needs to know of each key as
state, reads no old output, and waits with timers before it asks a client again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType


def pending(rows: DataFrame, done: DataFrame, key: str, retry_failed: bool = False) -> DataFrame:
    """Rows still to do. Failures are done too, unless retry_failed."""
    over = done.filter("error_type IS NULL OR error_type = ''") if retry_failed else done
    return rows.join(over.select(key).distinct(), key, "left_anti")


def score_new(spark: SparkSession, source: str, schema: StructType, out: str, checkpoint: str, key: str, score: Callable[[DataFrame], DataFrame]) -> None:
    """Score what a directory of Parquet files has gained since the last call.

    Files are tracked by the stream's checkpoint; keys that came before in another file
    are left out by an anti-join with the output. One micro-batch round, then it stops,
    so it can be called from a schedule; a failed round is done again.
    """

    def batch(df: DataFrame, epoch: int) -> None:
        from corvane.sources.files import exists

        fresh = df.dropDuplicates([key])
        if exists(spark, out):
            fresh = pending(fresh, spark.read.parquet(out).withColumn("error_type", F.lit("")), key)
        score(fresh).write.mode("append").parquet(out)

    query = spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


#: States of a key: waiting for another try, scored, given up.
WAITING, SCORED, FAILED = "waiting", "scored", "failed"


def transient(error: Exception) -> bool:
    """Whether it carries a status that another try may mend."""
    status = getattr(error, "status", 0)
    return status == 429 or 500 <= status < 600


class Scoring(StatefulProcessor):
    """For each key one answer of the client, over all batches and restarts.

    A transient error sets a timer for min(30, 2^k) times `wait` milliseconds after the
    k-th try; its expiry asks again. After `retries` more tries, or by any other error, the
    key fails, with a row that says so; it is asked anew when it comes in again only with
    `retry_failed`. State is the key's status, tries and, while it waits, its text.
    """

    def __init__(self, client: Callable[[str], str], retries: int = 3, wait: float = 1000, retry_failed: bool = False):
        self.client, self.retries, self.wait, self.retry_failed = client, retries, wait, retry_failed

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "status string, tries int, text string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        first = next(rows)
        for _ in rows:  # repeats of a key are one
            pass
        had = self.state.get() if self.state.exists() else None
        if had is None or (had[0] == FAILED and self.retry_failed):
            yield from self._ask(key, first.text, 0, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        had = self.state.get() if self.state.exists() else None
        if had is not None and had[0] == WAITING:
            yield from self._ask(key, had[2], had[1], timerValues)

    def _ask(self, key, text: str | None, tries: int, timers) -> Iterator[Row]:
        try:
            reply = self.client(text or "")
        except Exception as e:  # noqa: BLE001  one bad row must not end the stream
            if transient(e) and tries < self.retries:
                self.state.update((WAITING, tries + 1, text))
                self.handle.registerTimer(timers.getCurrentProcessingTimeInMs() + int(self.wait * min(30, 2**tries)))
                return
            self.state.update((FAILED, tries + 1, None))
            yield Row(key=key[0], response=None, error_type=type(e).__name__, tries=tries + 1)
        else:
            self.state.update((SCORED, tries + 1, None))
            yield Row(key=key[0], response=reply, error_type="", tries=tries + 1)

    def close(self) -> None:
        pass


def score_once(rows: DataFrame, key: str, text: str, client: Callable[[str], str], out: str, checkpoint: str, retries: int = 3, wait: float = 1000, retry_failed: bool = False, every: str = "1 second"):
    """The running query that appends (key, response, error_type, tries) of each key of the
    streaming frame `rows` to `out`, once. Rows with a null key are left out. The session's
    state store must be RocksDB's, which keeps any number of keys on disk."""
    kind = dict(rows.dtypes)[key]
    keyed = rows.filter(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    scored = keyed.groupBy("key").transformWithState(Scoring(client, retries, wait, retry_failed), f"key {kind}, response string, error_type string, tries int", "append", "processingTime")
    return scored.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(processingTime=every).start()
