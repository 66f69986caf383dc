"""Stored snapshots: written so that look-ups read little, and maintained by a job that may be killed at any moment.

Sessions are written in the order of their codes, with Bloom filters on the code, beside a table of their files in the order
of file ids: a look-up is a filter that reaches the scan, which then skips what can't have the key. A version of the store
is a folder for each table; the newest whose sessions are written is the one that holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.predicates import active
from ..operators import integrity

#: Rows for which a Bloom filter is sized, and bytes of a row group: smaller ones can be skipped better.
KEYS, GROUP_BYTES = 100_000, 16 << 20


def _write(rows: DataFrame, path: str, by: str, keys: int, group_bytes: int) -> None:
    laid = rows.repartitionByRange(by).sortWithinPartitions(by).write.mode("overwrite")
    laid.option(f"parquet.bloom.filter.enabled#{by}", "true").option(f"parquet.bloom.filter.expected.ndv#{by}", keys).option("parquet.block.size", group_bytes).parquet(path)


def write(sessions: DataFrame, path: str, *, keys: int = KEYS, group_bytes: int = GROUP_BYTES) -> None:
    """Sessions, and a row (file_id, token, code, expires_at) for each of their files."""
    files = sessions.select(F.explode("files").alias("f"), "code", "expires_at")
    _write(files.select(F.col("f.gridfsId").alias("file_id"), F.col("f.token").alias("token"), "code", "expires_at"), f"{path}/files", "file_id", keys, group_bytes)
    _write(sessions, f"{path}/sessions", "code", keys, group_bytes)


def find_session(spark: SparkSession, path: str, code: str, as_of: Column | None = None) -> DataFrame:
    """At most one row; with a moment only if it isn't expired then."""
    hit = spark.read.parquet(f"{path}/sessions").where(F.col("code") == code)
    return (hit if as_of is None else hit.where(active(F.col("expires_at"), as_of))).limit(1)


def find_by_file(spark: SparkSession, path: str, file_id: str, token: str, as_of: Column) -> DataFrame:
    """Sessions with such a file id and such a token, which may be of different files: the codes that have the file, then those
    sessions."""
    codes = spark.read.parquet(f"{path}/files").where((F.col("file_id") == file_id) & active(F.col("expires_at"), as_of)).select("code").distinct()
    # Codes that share a file id are few: a file is of one session.
    held = [r.code for r in codes.limit(2).collect()]
    sessions = spark.read.parquet(f"{path}/sessions")
    hit = sessions.where(F.col("code").isin(held)) if len(held) < 2 else sessions.join(codes, "code", "left_semi")
    return hit.where(F.exists("files", lambda f: f["token"] == token) & F.exists("files", lambda f: f["gridfsId"] == file_id) & active(F.col("expires_at"), as_of))


# Maintenance

TABLES = ("chunks", "files", "sessions")


def _versions(spark: SparkSession, root: str, table: str) -> list[int]:
    """The versions of a table that are written to the end. There are few: they are cleared as the store sees fit."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{root}/{table}")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    found = [s.getPath() for s in fs.listStatus(path)]
    return sorted(int(p.getName()) for p in found if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def current(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Chunks, files and sessions of the newest version that is there as a whole; sessions are written last."""
    at = _versions(spark, root, TABLES[-1])[-1]
    return tuple(spark.read.parquet(f"{root}/{t}/{at}") for t in TABLES)


def put(root: str, chunks: DataFrame, files: DataFrame, sessions: DataFrame, version: int = 0) -> None:
    for name, table in zip(TABLES, (chunks, files, sessions), strict=True):
        table.write.mode("overwrite").parquet(f"{root}/{name}/{version}")


def maintain(spark: SparkSession, root: str, batch: int, as_of: Column) -> None:
    """One run: expired sessions go with their files and chunks, and so do files of no session and chunks of no file.

    What is to go is written first, under the batch's number, and holds for a run that begins again. Then chunks, files and
    sessions are written in this order as the next version; until the last is there, the version before holds. A batch that
    is done changes nothing when it comes again.
    """
    done = _versions(spark, root, TABLES[-1])
    if batch + 1 in done or (done and done[-1] > batch + 1):
        return
    chunks, files, sessions = current(spark, root)
    if batch not in _versions(spark, root, "plans"):
        integrity.deletion_plan(sessions, files, chunks, as_of).distinct().write.mode("overwrite").parquet(f"{root}/plans/{batch}")
    plan = spark.read.parquet(f"{root}/plans/{batch}")
    gone = lambda kind, name: plan.where(F.col("kind") == kind).select(F.col("id").alias(name)).distinct()
    dead = gone("file", "files_id").unionByName(gone("chunks", "files_id"))
    put(root, chunks.join(dead, "files_id", "left_anti").select(chunks.columns), files.join(gone("file", "_id"), "_id", "left_anti"), sessions.join(gone("session", "code"), "code", "left_anti"), batch + 1)


def maintenance(spark: SparkSession, root: str, every: str, checkpoint: str, now: Column | None = None):
    """Starts a stream whose batches are runs; a batch that was cut off comes again with its number. Gives the running query."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    run = lambda _, batch: maintain(spark, root, batch, F.current_timestamp() if now is None else now)
    return ticks.writeStream.option("checkpointLocation", checkpoint).foreachBatch(run).trigger(processingTime=every).start()


