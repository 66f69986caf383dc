"""Tables, environment files, uploads, frames and blobs."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.predicates import frame_too_big
from ..functions.strings import js_trim, mime_if_null
from ..limits import LIMITS
from ..schemas import SCHEMAS


def read_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A Parquet table by its declared schema."""
    return spark.read.schema(SCHEMAS[name]).parquet(path)


def read_env(spark: SparkSession, path: str) -> DataFrame:
    """``key``, ``value`` of an environment file: no blanks, no comments, split at the first ``=``, first definition wins.

    Spark's own readers skip files whose names begin with a dot, so the file, which is small, is opened on its file
    system and its lines are numbered here.
    """
    jvm = spark.sparkContext._jvm
    file = jvm.org.apache.hadoop.fs.Path(path)
    stream = file.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(file)
    try:
        content = jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    numbered = spark.createDataFrame(list(enumerate(content.split("\n"))), "at long, value string")
    lines = numbered.select(js_trim(F.col("value")).alias("line"), "at")
    kept = lines.where((F.length("line") > 0) & ~F.col("line").startswith("#") & F.col("line").contains("="))
    parts = F.split("line", "=", 2)
    named = kept.select(js_trim(parts[0]).alias("key"), js_trim(parts[1]).alias("value"), "at")
    return named.groupBy("key").agg(F.min_by("value", "at").alias("value"))


def settings(spark: SparkSession, path: str, names: list[str]) -> dict[str, str]:
    """The settings of the given names: those of the process, else those of the file. A file of settings is small."""
    of_file = {r.key: r.value for r in read_env(spark, path).where(F.col("key").isin(names)).collect()}
    return of_file | {n: os.environ[n] for n in names if n in os.environ}


def read_uploads(spark: SparkSession, path: str, *, limit: int = LIMITS.stored_payload_bytes) -> DataFrame:
    """Files as rows (path, modificationTime, length, content), with ``accepted`` by size."""
    files = spark.read.format("binaryFile").load(path)
    return files.withColumn("accepted", F.col("length") <= limit)


def upload_errors(parts: DataFrame, key: str = "request_id", *, files: int = LIMITS.upload_files, file_bytes: int = LIMITS.stored_payload_bytes, field_bytes: int = LIMITS.field_bytes) -> DataFrame:
    """``error`` of each multipart request (key, at, kind file/field, length): that of the first part that breaks a limit,
    or null. ``at`` is a part's place in its request; a request is refused as a whole."""
    file = F.col("kind") == "file"
    upto = Window.partitionBy(key).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    counted = parts.withColumn("_files", F.sum(file.cast("int")).over(upto))
    error = F.when(file & (F.col("_files") > files), F.lit("LIMIT_FILE_COUNT")).when(file & (F.col("length") > file_bytes), F.lit("LIMIT_FILE_SIZE"))
    error = error.when(~file & (F.col("length") > field_bytes), F.lit("LIMIT_FIELD_VALUE"))
    told = counted.withColumn("_error", error)
    return told.groupBy(key).agg(F.min_by("_error", F.when(F.col("_error").isNotNull(), F.col("at"))).alias("error"))


def process_metrics(spark: SparkSession) -> DataFrame:
    """One row about the driver: when it started, for how long it is up, its heap, and the cores of the application."""
    runtime, sc = spark.sparkContext._jvm.java.lang.Runtime.getRuntime(), spark.sparkContext
    row = (sc.startTime, runtime.totalMemory() - runtime.freeMemory(), runtime.maxMemory(), sc.defaultParallelism)
    rows = spark.createDataFrame([row], "started_ms long, heap_used long, heap_max long, cores int")
    return rows.withColumn("uptime_ms", F.unix_millis(F.current_timestamp()) - F.col("started_ms"))


def parse_frames(events: DataFrame, *, limit: int = LIMITS.frame_bytes) -> DataFrame:
    """Adds ``payload`` (VARIANT), ``type`` and ``close_code``: 1009 for a frame too big, 1003 for no JSON, else null."""
    parsed = events.withColumn("payload", F.when(~frame_too_big(F.col("raw"), limit), F.try_parse_json("raw")))
    code = F.when(frame_too_big(F.col("raw"), limit), F.lit(1009)).when(F.col("payload").isNull(), F.lit(1003))
    return parsed.withColumn("type", F.try_variant_get("payload", "$.type", "string")).withColumn("close_code", code)


def client_frames(events: DataFrame) -> DataFrame:
    """Frames as a client reads them: what is no JSON is left out."""
    return events.withColumn("payload", F.try_parse_json("raw")).where("payload IS NOT NULL")


def by_kind(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Text and binary messages of a transfer."""
    return events.where("kind = 'json'"), events.where("kind = 'binary'")


def read_blobs(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """``_id``, ``filename``, ``mimeType`` and ``data`` of files, their chunks put together in order."""
    from ..operators.transfer import reassemble

    data = reassemble(chunks.select("files_id", "n", "data"), ["files_id"], seq="n")
    joined = files.join(data.withColumnRenamed("files_id", "_id"), "_id", "left")
    return joined.select("_id", "filename", mime_if_null(F.col("metadata.mimeType")).alias("mimeType"), F.coalesce("data", F.lit(b"")).alias("data"))


def split_blobs(uploads: DataFrame, *, chunk_bytes: int = 255 * 1024) -> DataFrame:
    """Chunk rows (files_id, n, data) of uploads (_id, data)."""
    from ..operators.transfer import split

    return split(uploads.select("_id", "data"), chunk_bytes=chunk_bytes).select(F.col("_id").alias("files_id"), F.col("seq").alias("n"), "data")
