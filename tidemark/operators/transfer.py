"""Chunked transfers: splitting, progress over ordered chunks, attribution to files, and reassembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import js_round
from ..limits import LIMITS
from .receiving import received_files

#: Places in a key's order, and bytes of its stream, that a task sums or attributes by itself.
PLACES, SPAN = 1 << 16, 64 << 20


def chunk_count(size: Column, chunk_bytes: int = LIMITS.chunk_bytes) -> Column:
    return F.ceil(size / chunk_bytes)


def totals(files: DataFrame, key: str, *, size: str = "size", chunk_bytes: int = LIMITS.chunk_bytes) -> DataFrame:
    """Bytes and chunks of each transfer; chunks are counted for each file first."""
    return files.groupBy(key).agg(F.sum(size).alias("bytes_total"), F.sum(chunk_count(F.col(size), chunk_bytes)).alias("chunks_total"))


def split(rows: DataFrame, data: str = "data", *, chunk_bytes: int = LIMITS.chunk_bytes) -> DataFrame:
    """A row for each chunk with its ``seq``; nothing for empty data."""
    n = F.octet_length(data)
    seqs = rows.where(n > 0).withColumn("seq", F.explode(F.sequence(F.lit(0), F.ceil(n / chunk_bytes).cast("int") - 1)))
    chunk = F.substring(F.col(data).cast("binary"), F.col("seq") * chunk_bytes + 1, F.lit(chunk_bytes))
    return seqs.withColumn(data, chunk).withColumn("byte_len", F.octet_length(data).cast("bigint"))


def reassemble(chunks: DataFrame, keys: list[str], *, data: str = "data", seq: str = "seq") -> DataFrame:
    """The chunks of each key put together in order, as binary; a key's bytes are one value."""
    joined = F.expr(f"listagg(`{data}`) WITHIN GROUP (ORDER BY `{seq}`)")
    return chunks.groupBy(*keys).agg(joined.alias(data), F.count(F.lit(1)).alias("chunks"))


def running(rows: DataFrame, key: str, order: str, sums: dict[str, Column]) -> DataFrame:
    """Adds running sums over each key's rows in the order of a whole number, which orders them totally.

    A key's rows are summed in runs of places, and the sums of earlier runs are added: a key of very many rows is in many
    tasks, and only one row of each run is looked at together.
    """
    placed = rows.withColumn("_run", F.floor(F.col(order) / PLACES))
    names = {name: f"_before_{i}" for i, name in enumerate(sums)}
    runs = placed.groupBy(key, "_run").agg(*[F.sum(v).alias(names[n]) for n, v in sums.items()])
    earlier = Window.partitionBy(key).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(F.col(key).alias("_key"), F.col("_run").alias("_same"), *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(c) for c in names.values()])
    out = placed.join(runs, placed[key].eqNullSafe(runs["_key"]) & placed["_run"].eqNullSafe(runs["_same"])).drop("_key", "_same")
    within = Window.partitionBy(key, "_run").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumns({n: F.col(names[n]) + F.sum(v).over(within) for n, v in sums.items()}).drop("_run", *names.values())


def progress(chunks: DataFrame, totals_: DataFrame, key: str, *, seq: str = "seq", size: str = "byte_len", at: str | None = None, started: str | None = None) -> DataFrame:
    """``bytes_done``, ``chunks_done``, ``percent`` after each chunk; with times also ``speed`` and ``time_remaining``.

    ``started`` is a column of ``totals_``: before the first chunk for a sender, the arrival of the list of files for a
    receiver. ``seq`` must order a transfer's chunks totally.
    """
    out = running(chunks, key, seq, {"bytes_done": F.col(size), "chunks_done": F.lit(1)}).join(totals_, key)
    share = js_round(F.col("bytes_done") / F.col("bytes_total") * 100).cast("bigint")
    out = out.withColumn("percent", F.when(F.col("bytes_total") > 0, share).otherwise(F.lit(100).cast("bigint")))
    if at:
        elapsed = (F.unix_millis(at) - F.unix_millis(started)) / 1000
        out = out.withColumn("speed", F.when(elapsed > 0, F.col("bytes_done") / elapsed).otherwise(F.lit(0.0)))
        out = out.withColumn("time_remaining", F.when(F.col("speed") > 0, (F.col("bytes_total") - F.col("bytes_done")) / F.col("speed")).otherwise(F.lit(0.0)))
    return out


def sender_files(files: DataFrame, key: str, *, position: str = "file_index", size: str = "size") -> DataFrame:
    """The range of bytes that each file has in its transfer."""
    return running(files, key, position, {"end": F.col(size)}).withColumn("start", F.col("end") - F.col(size))


def attribute(chunks: DataFrame, files: DataFrame, key: str, *, mode: str = "sender", seq: str = "seq", size: str = "byte_len") -> DataFrame:
    """``file_index`` of each chunk of (key, seq, byte_len), for files (key, file_index, size).

    "sender": chunks are cut at file ends, and a chunk belongs to the file whose bytes it has. "receiver": the place
    moves on after a chunk that fills its file, so an empty file takes the chunk that follows it.
    """
    if mode == "receiver":
        return received_files(chunks, files, key, seq=seq, size=size)
    # A chunk's file is the last that begins before it: one window over both, for each span of a transfer's bytes.
    placed = running(chunks, key, seq, {"_end": F.col(size)}).withColumn("_from", F.col("_end") - F.col(size)).drop("_end")
    placed = placed.withColumn("_span", F.floor(F.col("_from") / SPAN)).withColumn("_file", F.lit(None).cast(f"struct<file_index:{files.schema['file_index'].dataType.simpleString()},end:bigint>"))
    ranges = sender_files(files, key).where("end > start")
    spans = ranges.withColumn("_span", F.explode(F.sequence(F.floor(F.col("start") / SPAN), F.floor((F.col("end") - 1) / SPAN))))
    begins = spans.select(key, "_span", F.greatest("start", F.col("_span") * SPAN).alias("_from"), F.struct("file_index", F.col("end").cast("bigint").alias("end")).alias("_file"), F.lit(True).alias("_start"))
    both = placed.unionByName(begins, allowMissingColumns=True)
    upto = Window.partitionBy(key, "_span").orderBy("_from", F.col("_start").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    told = both.withColumn("_file", F.last("_file", ignorenulls=True).over(upto)).where(F.col("_start").isNull() & (F.col("_from") < F.col("_file.end")))
    return told.withColumn("file_index", F.col("_file.file_index")).drop("_from", "_span", "_file", "_start")


def file_progress(attributed: DataFrame, key: str, *, seq: str = "seq", size: str = "byte_len") -> DataFrame:
    upto = Window.partitionBy(key, "file_index").orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    return attributed.withColumn("file_bytes_done", F.sum(size).over(upto))


def live_meta(files: DataFrame, key: str, *, chunk_bytes: int = LIMITS.chunk_bytes) -> DataFrame:
    """The message that opens a transfer, as JSON, from files (key, file_index, name, mimeType, size)."""
    from ..functions.strings import mime_or_default

    listed = F.array_sort(F.collect_list(F.struct("file_index", "name", mime_or_default(F.col("mimeType")).alias("mimeType"), "size")))
    shown = F.transform(listed, lambda f: F.struct(f["name"].alias("name"), f["mimeType"].alias("mimeType"), f["size"].alias("size")))
    rows = files.groupBy(key).agg(shown.alias("files"), F.sum(chunk_count(F.col("size"), chunk_bytes)).alias("totalChunks"))
    return rows.select(key, F.to_json(F.struct(F.lit("meta").alias("type"), "files", "totalChunks")).alias("json"))


def too_big_files(files: DataFrame, limit: int = LIMITS.live_file_bytes) -> DataFrame:
    return files.where(F.col("size") > limit)
