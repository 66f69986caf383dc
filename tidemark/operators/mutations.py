"""Changes as rewrites of a snapshot: each takes tables and gives the tables that replace them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def insert_sessions(stored: DataFrame, new: DataFrame, live: DataFrame | None = None) -> DataFrame:
    """The rows of ``new`` whose code isn't taken, one for each code (the first created; ties by the other columns in order)."""
    taken = stored.select("code") if live is None else stored.select("code").unionByName(live.select("code"))
    free = new.join(taken, "code", "left_anti")
    others = [F.col(c) for c in free.columns if c != "code"]
    tied = [c for c in others_of(free) if free.schema[c].dataType.typeName() not in ("map", "variant")]
    first = free.groupBy("code").agg(F.min_by(F.struct(*others), F.struct("created_at", *tied)).alias("row"))
    return first.select("code", "row.*").select(*free.columns)


def others_of(rows: DataFrame) -> list[str]:
    """The columns that order rows of one code and one time: all that can be compared."""
    return [c for c in rows.columns if c not in ("code", "created_at")]


def insert_with_retries(stored: DataFrame, new: DataFrame, candidates: str, *, live: DataFrame | None = None, attempts: int = 5) -> DataFrame:
    """The rows of ``new`` (with ``created_at`` and a key ``row``) under the first of their candidate codes that is free when
    they try it, in so many rounds at most; rows that never find one are left out."""
    taken = stored.select("code") if live is None else stored.select("code").unionByName(live.select("code"))
    left, placed = new, None
    for k in range(attempts):
        trying = left.where(F.size(candidates) > k).withColumn("code", F.get(candidates, F.lit(k)))
        done = insert_sessions(taken, trying)
        placed = done if placed is None else placed.unionByName(done)
        taken = taken.unionByName(done.select("code"))
        left = left.join(done.select("row"), "row", "left_anti")
    return placed


def update_sessions(stored: DataFrame, changes: DataFrame) -> DataFrame:
    """Latest change for each code wins: files, text and expiry are replaced, password and burning only if they are given.

    ``changes`` has ``code``, ``updated_at``, ``files``, ``text``, ``expires_at``, ``password``, ``burn_on_read``.
    """
    latest = changes.groupBy("code").agg(F.max_by(F.struct("files", "text", "expires_at"), "updated_at").alias("always"), F.max_by("password", F.when(F.col("password").isNotNull(), F.col("updated_at"))).alias("new_password"), F.max_by("burn_on_read", F.when(F.col("burn_on_read").isNotNull(), F.col("updated_at"))).alias("new_burn"))
    joined = stored.join(latest, "code", "left")
    always = lambda c: F.when(F.col("always").isNotNull(), F.col(f"always.{c}")).otherwise(F.col(c)).alias(c)
    replaced = {c: always(c) for c in ("files", "text", "expires_at")}
    replaced |= {"password": F.coalesce("new_password", "password").alias("password"), "burn_on_read": F.coalesce("new_burn", "burn_on_read").alias("burn_on_read")}
    return joined.select(*[replaced.get(c, F.col(c)) for c in stored.columns])


def latest_by(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """One row for each key, the last in order; one aggregate, without sorting whole groups."""
    others = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("row")).select(key, "row.*").select(*rows.columns)


def delete_by(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """What is left without the given keys; keys that aren't there change nothing."""
    return rows.join(gone.select(key), key, "left_anti")


def cascade_delete(sessions: DataFrame, files: DataFrame, chunks: DataFrame, codes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Chunks, files and sessions that are left; to be written in this order, so a session never lacks its files."""
    ids = sessions.join(codes.select("code"), "code", "left_semi").select(F.explode("files.gridfsId").alias("_id"))
    left_chunks = chunks.join(ids.select(F.col("_id").alias("files_id")), "files_id", "left_anti")
    return left_chunks, files.join(ids, "_id", "left_anti"), delete_by(sessions, codes, "code")


def upsert_last(rows: DataFrame, new: DataFrame, key: str, position: str) -> DataFrame:
    """Rows with the new ones in place of those of their keys, after all others by ``position``."""
    end = rows.agg(F.coalesce(F.max(position), F.lit(-1)) + 1)
    placed = new.withColumn(position, F.col(position) + end.scalar())
    return delete_by(rows, new, key).unionByName(placed.select(*rows.columns))


def retained(sessions: DataFrame, as_of, retention_ms: int) -> DataFrame:
    return sessions.where(F.unix_millis("expires_at") + retention_ms > F.unix_millis(as_of))
