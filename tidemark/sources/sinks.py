"""Where results go: snapshots, JSON answers, and messages to connections that are open."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_snapshot(df: DataFrame, path: str, *, partition_by: list[str] | None = None) -> None:
    """Replaces a table. The path must not be one that ``df`` reads from."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def json_answers(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct("*")).alias("value"))


def download_headers(blobs: DataFrame) -> DataFrame:
    """The headers of a blob's download."""
    from ..functions.strings import encode_component

    name = F.concat(F.lit('attachment; filename="'), encode_component(F.col("filename")), F.lit('"'))
    return blobs.withColumn("content_type", F.col("mimeType")).withColumn("content_disposition", name)


def download_stream(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """The pieces (_id, n, data) of blobs in the order in which they are sent; the first of each has the headers as well.

    No blob is put together: a piece is a row. A blob without chunks has one piece of no bytes."""
    from ..functions.strings import mime_if_null

    heads = download_headers(files.select("_id", "filename", mime_if_null(F.col("metadata.mimeType")).alias("mimeType")))
    sent = heads.join(chunks.select(F.col("files_id").alias("_id"), "n", "data"), "_id", "left")
    first = F.coalesce("n", F.lit(0)) == 0
    pieces = sent.select("_id", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("data", F.lit(b"")).alias("data"), F.when(first, F.col("content_type")).alias("content_type"), F.when(first, F.col("content_disposition")).alias("content_disposition"))
    return pieces.repartition("_id").sortWithinPartitions("_id", "n")


def log_lines(events: DataFrame, level: str, message: str, *, at: str = "ts") -> DataFrame:
    """Structured log lines of events: level, time in milliseconds, message, and the other columns by their names."""
    others = [F.col(c) for c in events.columns if c != at]
    return events.select(F.to_json(F.struct(F.lit(level).alias("level"), F.unix_millis(F.col(at).cast("timestamp")).alias("time"), *others, F.lit(message).alias("msg"))).alias("value"))


def write_log(lines: DataFrame, path: str) -> None:
    lines.write.mode("append").text(path)


def send_if_open(messages: DataFrame, channels: DataFrame, key: str = "peer_id") -> DataFrame:
    """Messages that have a payload and whose data channel is open; the others are dropped."""
    return messages.where("payload IS NOT NULL").join(channels.where("state = 'open'").select(key), key, "left_semi")


def deliverable(messages: DataFrame, connections: DataFrame) -> DataFrame:
    """Messages to connections that are open; the others are dropped."""
    return messages.join(connections.where("state = 'open'").select("conn_id"), "conn_id", "left_semi")


def each_batch(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str):
    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(handle)


class SingleFlight:
    """Runs a job unless it is running already: an overlapping call is skipped, and counted."""

    def __init__(self, job: Callable[..., None]):
        self.job, self.skipped, self._running = job, 0, threading.Lock()

    def __call__(self, *args) -> bool:
        if not self._running.acquire(blocking=False):
            self.skipped += 1
            return False
        try:
            self.job(*args)
        finally:
            self._running.release()
        return True


def periodic(spark: SparkSession, job: Callable[[int], None], every: str, checkpoint: str):
    """Starts a stream that runs a job at each interval ("10 minutes"), never twice at a time; gives the running query."""
    guarded = job if isinstance(job, SingleFlight) else SingleFlight(job)
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return each_batch(ticks, lambda _, number: guarded(number), checkpoint).trigger(processingTime=every).start()


def with_retry(action: Callable, may_retry: Callable[[Exception], bool], *, again: Callable[[], None] = lambda: None, times: int = 1, wait_s: float = 0.0):
    """An action's result; after an error that a further attempt may cure, ``again`` (a reconnect) and so many more attempts."""
    for left in range(times, -1, -1):
        try:
            return action()
        except Exception as error:
            if not left or not may_retry(error):
                raise
            again()
            time.sleep(wait_s)
