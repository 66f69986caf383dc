"""Tables written to the folder that driver and executors share, to cut lineage between the rounds of a fixpoint."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only by sessions on one machine that name no folder (tests).
LOCAL = "/tmp/checkpoints"


def folder(spark: SparkSession) -> str:
    """That of ``spark.checkpoint.dir``, else the one set on the context."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return LOCAL


def save(df: DataFrame, name: str) -> DataFrame:
    """Written and reread. The table stays until whoever owns the folder clears it, as results may be read at any time."""
    path = f"{folder(df.sparkSession)}/tidemark-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
