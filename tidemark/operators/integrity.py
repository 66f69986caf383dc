"""Referential integrity between sessions, blobs and chunks, and expiry. Each gives a plan: what to delete and why."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import expired


def referenced_ids(sessions: DataFrame, files: str = "files", field: str = "gridfsId") -> DataFrame:
    """Distinct blob ids that sessions refer to, as ``_id``."""
    return sessions.select(F.explode(F.col(f"{files}.{field}")).alias("_id")).where("_id IS NOT NULL").distinct()


def orphan_files(files: DataFrame, sessions: DataFrame, *, as_of: Column | None = None, min_age_ms: int = 0) -> DataFrame:
    """Blobs that no session refers to. A minimum age spares uploads whose session isn't written yet."""
    out = files.join(sessions.select(F.explode("files.gridfsId").alias("_id")), "_id", "left_anti")
    if as_of is not None and min_age_ms:
        out = out.where(F.unix_millis("upload_date") + min_age_ms <= F.unix_millis(as_of))
    return out


def referenced_files(files: DataFrame, sessions: DataFrame) -> DataFrame:
    return files.join(sessions.select(F.explode("files.gridfsId").alias("_id")), "_id", "left_semi")


def orphan_chunk_ids(chunks: DataFrame, files: DataFrame) -> DataFrame:
    """Distinct ``files_id`` of chunks without a file."""
    return chunks.select("files_id").distinct().join(files.select(F.col("_id").alias("files_id")), "files_id", "left_anti")


def expiry_partition(sessions: DataFrame, as_of: Column) -> DataFrame:
    """How many sessions are expired and how many are armed again."""
    over = expired(F.col("expires_at"), as_of)
    return sessions.agg(F.count_if(over).alias("expired"), F.count_if(~over).alias("rescheduled"))


def deletion_plan(sessions: DataFrame, files: DataFrame, chunks: DataFrame, as_of: Column) -> DataFrame:
    """``kind``, ``id``, ``reason`` of what maintenance removes."""
    dead = sessions.where(expired(F.col("expires_at"), as_of))
    plans = [
        orphan_files(files, sessions).select(F.lit("file").alias("kind"), F.col("_id").alias("id"), F.lit("no session").alias("reason")),
        orphan_chunk_ids(chunks, files).select(F.lit("chunks").alias("kind"), F.col("files_id").alias("id"), F.lit("no file").alias("reason")),
        dead.select(F.lit("session").alias("kind"), F.col("code").alias("id"), F.lit("expired").alias("reason")),
        referenced_ids(dead).select(F.lit("file").alias("kind"), F.col("_id").alias("id"), F.lit("session expired").alias("reason")),
    ]
    out = plans[0]
    for p in plans[1:]:
        out = out.unionByName(p)
    return out


def store_stats(files: DataFrame) -> DataFrame:
    return files.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("data_size"), F.count(F.lit(1)).alias("objects"))
