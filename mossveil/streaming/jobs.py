"""The row-local operators over streams, stateful rate limiting, and a job over a folder of files."""

from __future__ import annotations

import os
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from mossveil.operators import scan
from mossveil.operators.limits import admit
from mossveil.sources import files

STATE_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def mask_stream(stream: DataFrame, text: str = "text", strategy: str = "mask", **options) -> DataFrame:
    """Rewritten texts of a stream; raw text and found values do not leave it."""
    done = scan.anonymize(scan.scan(stream, text), text, strategy, **options)
    return done.drop(text, "spans")


class Limiter(StatefulProcessor):
    """One client: the times of its admitted requests within the window, and a timer at which the last of them ends."""

    def __init__(self, limit: int, window: float):
        self.limit, self.window = limit, window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getListState("seen", "at double")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values("at", kind="stable")
        seen = deque(t for (t,) in self.seen.get()) if self.seen.exists() else deque()
        answers = [admit(seen, at, self.limit, self.window) for at in batch["at"]]
        self.seen.put([(float(t),) for t in seen])
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(int((seen[-1] + self.window) * 1000) + 1)
        yield pd.DataFrame({"client": batch["client"], "at": batch["at"], "allowed": [a for a, _ in answers], "retry_after": pd.Series([w for _, w in answers], dtype="int32", index=batch.index)})

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.seen.clear()
        yield pd.DataFrame({"client": pd.Series(dtype="str"), "at": pd.Series(dtype="float64"), "allowed": pd.Series(dtype="bool"), "retry_after": pd.Series(dtype="int32")})

    def close(self) -> None:
        pass


def rate_limit_stream(requests: DataFrame, limit: int = 60, window: float = 60.0, delay: str = "0 seconds") -> DataFrame:
    """``client, at, allowed, retry_after`` for a stream of ``client`` and ``at`` (seconds since 1970), by the data's time.

    A client's state is the times of at most ``limit`` admitted requests; it goes when the watermark (the latest time
    of any client, less ``delay``) has passed the end of the last one's window, and not before, however long the
    stream pauses or lags. Requests of a micro-batch are answered in order of time; one that comes after a later one
    has been answered is judged by what has been admitted so far, and one behind the watermark gets no answer.
    Requests without a time are denied, and have no part in the state; null clients are one client. Needs the RocksDB
    state store (``spark.sql.streaming.stateStore.providerClass``), which is set if the session has none of its own.
    """
    spark = requests.sparkSession
    if not spark.conf.get("spark.sql.streaming.stateStore.providerClass", "").endswith("RocksDBStateStoreProvider"):
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_PROVIDER)
    out = "client string, at double, allowed boolean, retry_after int"
    timed = requests.select("client", "at").where("at IS NOT NULL").withColumn("_time", F.timestamp_micros((F.col("at") * 1e6).cast("long"))).withWatermark("_time", delay)
    answered = timed.groupBy("client").transformWithStateInPandas(Limiter(limit, window), out, "Append", "eventTime")
    without = requests.where("at IS NULL").select("client", "at", F.lit(False).alias("allowed"), F.lit(0).alias("retry_after"))
    return answered.union(without)


# ---- a folder of files ----------------------------------------------------------------------------------------------
FILE = "path string, modificationTime timestamp, length long, content binary"
STATUSES = ("waiting", "processing", "done", "failed")


class Stopped(RuntimeError):
    """The stop marker was there before a batch."""


def file_job(spark: SparkSession, folder: str, state: str, stop: str | None = None, files_per_batch: int = 100, **options) -> DataFrame:
    """Write a masked copy of every text file of ``folder`` that no earlier run has handled; the statuses after it.

    A stream over the folder that ends when nothing is left. What is done is kept under ``state``: the stream's own
    checkpoint, and a table of statuses, one row a file and change. Files that cannot be read, or whose copy is there
    already, are ``failed`` with the reason; masked copies and other kinds of files are no tasks. If a file ``stop``
    exists before a batch, that batch and the rest stay ``waiting``, and a later call goes on with them. A batch that
    is lost half-way is repeated as a whole: copies that it had made are then reported as there already.
    """
    table = os.path.join(state, "statuses")

    def step(batch: DataFrame, number: int) -> None:
        if stop and os.path.exists(stop):
            raise Stopped(stop)
        found = files.texts_of(batch).where("status NOT IN ('masked copy', 'unsupported')")
        note(found.select("path", F.lit("processing").alias("status"), F.lit(None).cast("string").alias("reason")), number)
        done = scan.anonymize(scan.scan(found.where("status = 'ok'")), **options).select("path", "anonymized")
        copies = files.write_masked_copies(done).select("path", F.when(F.col("status") == "written", "done").otherwise("failed").alias("status"), F.when(F.col("status") != "written", F.col("status")).alias("reason"))
        note(copies.union(found.where("status <> 'ok'").select("path", F.lit("failed").alias("status"), F.col("status").alias("reason"))), number)

    def note(rows: DataFrame, number: int) -> None:
        rows.withColumn("batch", F.lit(number)).withColumn("at", F.current_timestamp()).write.mode("append").parquet(table)

    stream = spark.readStream.schema(FILE).format("binaryFile").option("maxFilesPerTrigger", files_per_batch).load(folder)
    query = stream.writeStream.foreachBatch(step).option("checkpointLocation", os.path.join(state, "checkpoint")).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    except StreamingQueryException as e:
        if Stopped.__name__ not in str(e):
            raise
    return file_statuses(spark, folder, state)


def file_statuses(spark: SparkSession, folder: str, state: str) -> DataFrame:
    """``path, status, reason`` of every task of a folder: the latest that is known, else ``waiting``."""
    listed = files.texts_of(spark.read.format("binaryFile").load(folder)).where("status NOT IN ('masked copy', 'unsupported')").select("path")
    try:
        known = spark.read.parquet(os.path.join(state, "statuses"))
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return listed.select("path", F.lit("waiting").alias("status"), F.lit(None).cast("string").alias("reason"))
    latest = W.partitionBy("path").orderBy(F.desc("batch"), F.col("status") == "processing", F.desc("at"))
    last = known.withColumn("_n", F.row_number().over(latest)).where("_n = 1").select("path", "status", "reason")
    return listed.join(last, "path", "left").select("path", F.coalesce("status", F.lit("waiting")).alias("status"), "reason")
