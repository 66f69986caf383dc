"""Shared storage, written intermediate tables, and joins that deal out hot keys."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship as _ship

__all__ = ["Workspace", "checkpoint_dir", "drop", "join_by_key", "scratch", "ship"]

#: Used only by sessions on one machine that name no folder (tests).
LOCAL_CHECKPOINTS = "/tmp/checkpoints"
#: A key with more rows than both 1/HOT of all and FEW_ROWS is dealt out; fewer than HOT keys can be that hot.
HOT, FEW_ROWS = 4096, 1000


#: Rows in a batch that goes to Python, where the session leaves that at Spark's default: texts are long.
BATCH_ROWS, _BATCHES = 2000, "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship(spark: SparkSession) -> None:
    """Makes this package known to Python workers, and batches of texts small enough for them."""
    _ship(spark)
    if spark.conf.get(_BATCHES, "10000") == "10000":
        spark.conf.set(_BATCHES, BATCH_ROWS)


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: that of ``spark.checkpoint.dir``, else the one set on the context."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return LOCAL_CHECKPOINTS


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{checkpoint_dir(spark)}/tidemark-{name}-{uuid.uuid4().hex}"


def drop(spark: SparkSession, *paths: str) -> None:
    jvm = spark.sparkContext._jvm
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


class Workspace:
    """Tables written in the shared folder: they cut lineage, and outlive lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, scratch(spark, name), 0

    def save(self, df: DataFrame, name: str = "t") -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}-{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def finish(self, df: DataFrame) -> DataFrame:
        """Writes the result beside the workspace and removes the rest."""
        path = f"{self.root}-result"
        df.write.parquet(path)
        drop(self.spark, self.root)
        return self.spark.read.schema(df.schema).parquet(path)


def join_by_key(rows: DataFrame, per_key: DataFrame, keys: list[str], spread_by: str, *, n: str = "n", total: int | None = None, how: str = "inner") -> DataFrame:
    """Join with a written table of one row a key, whose column ``n`` counts the key's rows (it is not returned).

    Rows of hot keys are dealt over as many salts as their count asks for, by a hash of ``spread_by``. There are fewer
    than HOT such keys, so their list is broadcast; all other keys are joined as they are.
    """
    if total is None:
        total = per_key.agg(F.sum(n)).first()[0] or 0
    share = max(FEW_ROWS, total // HOT)
    hot = F.broadcast(per_key.where(F.col(n) > share).select(*keys, F.ceil(F.col(n) / share).cast("int").alias("_salts")))
    wide = per_key.drop(n) if n not in keys else per_key
    wide = wide.join(hot, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")
    salt = F.coalesce(F.pmod(F.xxhash64(spread_by), F.coalesce("_salts", F.lit(1))).cast("int"), F.lit(0))
    dealt = rows.join(hot, keys, "left").withColumn("_salt", salt).drop("_salts")
    return dealt.join(wide, [*keys, "_salt"], how).drop("_salt")
