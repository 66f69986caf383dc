"""What a receiver makes of a transfer's messages: lists of files, their chunks, and how each list ends.

Lists cut a transfer into runs that don't depend on each other. In a run a file takes chunks until it has its size, so the
chunk that fills it is found by bisection in the running sum of bytes: one step for each file, none for each chunk. Rows
stream through a task in Arrow batches, and what is held is the sizes of a run's files; sums are Spark's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..limits import LIMITS
from ..shipping import ship
from .anchors import key_of

#: What a list of files must look like; numbers beyond these fields are ignored.
META = "type STRING, totalChunks DOUBLE, files ARRAY<STRUCT<size: DOUBLE>>"


class Run:
    """A list of files being received: whose turn it is, what it has, and since when nothing has come."""

    def __init__(self, sizes: np.ndarray, total: int, ms: int | None):
        self.sizes, self.total, self.last = sizes, total, ms
        self.file = self.done = self.chunks = 0
        self.over = False

    def take(self, lengths: np.ndarray, is_end: np.ndarray, times: np.ndarray | None, gap_ms: int) -> tuple[np.ndarray, int | None, int]:
        """The file of each row (-1: none), the moment at which the run was given up, and the row that came too late."""
        n, files = len(lengths), np.full(len(lengths), -1, dtype=np.int32)
        if self.over:
            return files, None, n
        upto = np.cumsum(lengths)
        at, base = 0, 0
        file, done = self.file, self.done
        rows = np.flatnonzero(~is_end)
        sums = upto[rows]
        while at < len(rows) and file < len(self.sizes):
            full = max(at, int(np.searchsorted(sums, base + self.sizes[file] - done, side="left")))
            if full == len(rows):
                files[rows[at:]] = file
                done, at = done + int(sums[-1]) - base, full
            else:
                files[rows[at : full + 1]] = file
                base, at, file, done = int(sums[full]), full + 1, file + 1, 0
        heard = np.flatnonzero((files >= 0) | is_end)
        had = self.chunks + np.cumsum(files[heard] >= 0) - (files[heard] >= 0)
        gone, cut = None, n
        if times is not None and len(heard):
            since = np.concatenate([[self.last], times[heard][:-1]])
            late = np.flatnonzero((times[heard] - since > gap_ms) & (had < self.total))
            if len(late):
                gone, cut, self.over = int(since[late[0]]) + gap_ms, int(heard[late[0]]), True
                files[cut:] = -1
                return files, gone, cut
            self.last = int(times[heard[-1]])
        self.file, self.done, self.chunks = file, done, self.chunks + int((files >= 0).sum())
        return files, gone, cut


def taken(rows: DataFrame, *, gap_ms: int = 0, timed: bool = False) -> DataFrame:
    """Adds ``_file`` (the place of the file that takes a chunk, else null) and ``_gone_ms`` (when a run was given up) to rows
    in order, of which each run begins with one that has ``_sizes`` and ``_total``; ``_size``, ``_is_end`` and ``_ms`` are those
    of the others."""
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = None
        for batch in batches:
            if not batch.num_rows:
                continue
            lengths = batch.column("_size").fill_null(0).to_numpy(zero_copy_only=False)
            is_end = batch.column("_is_end").to_numpy(zero_copy_only=False)
            times = batch.column("_ms").fill_null(0).to_numpy(zero_copy_only=False) if timed else None
            begins = np.flatnonzero(batch.column("_sizes").is_valid().to_numpy(zero_copy_only=False))
            files, gone = np.full(batch.num_rows, -1, dtype=np.int32), [None] * batch.num_rows
            for a, b in zip([0, *begins.tolist()], [*begins.tolist(), batch.num_rows], strict=True):
                if a in begins:
                    here = Run(batch.column("_sizes")[a].values.to_numpy(), batch.column("_total")[a].as_py(), batch.column("_ms")[a].as_py())
                    a += 1
                if a < b and here is not None:
                    files[a:b], when, cut = here.take(lengths[a:b], is_end[a:b], None if times is None else times[a:b], gap_ms)
                    if when is not None:
                        gone[a + cut] = when
            new = [pa.array(files, mask=files < 0), pa.array(gone, pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, "_file", "_gone_ms"])

    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{out}, _file int, _gone_ms long")


def received_files(chunks: DataFrame, files: DataFrame, key: str, *, seq: str = "seq", size: str = "byte_len") -> DataFrame:
    """The place ``file_index`` of the file that takes each chunk; what comes after all files are full is left out. A null key
    is none. Files are those of (key, file_index, size); an empty file takes the chunk that is there."""
    listed = files.where(F.col(key).isNotNull()).groupBy(F.struct(F.col(key).alias("k0")).alias("_key"))
    listed = listed.agg(F.transform(F.array_sort(F.collect_list(F.struct("file_index", "size"))), lambda f: f["size"].cast("long")).alias("_sizes"))
    said = chunks.where(F.col(key).isNotNull()).select(key_of([key]).alias("_key"), F.col(seq).alias("_place"), F.col(size).alias("_bytes"), F.col(size).cast("long").alias("_size"))
    both = listed.withColumn("_total", F.lit(0).cast("long")).unionByName(said, allowMissingColumns=True).withColumns({"_is_end": F.lit(False), "_ms": F.lit(None).cast("long")})
    told = taken(both.repartition("_key").sortWithinPartitions("_key", F.col("_sizes").isNull(), "_place")).where("_file IS NOT NULL")
    return told.select(F.col("_key.k0").alias(key), F.col("_place").alias(seq), F.col("_bytes").alias(size), F.col("_file").alias("file_index"))


def receive(events: DataFrame, *, key: str = "transfer_id", seq: str = "seq", at: str | None = None, gap_ms: int = LIMITS.inactivity_ms, until: Column | None = None) -> DataFrame:
    """A row for each list of files that a transfer sent, of messages (key, seq, kind, json, byte_len): its ``number`` in the
    transfer, ``state``, ``chunks_done``, ``chunks_total``, ``count_matches`` and the bytes of each file.

    States: completed; aborted; timed out (``at`` is given, and nothing came for longer than ``gap_ms`` with chunks missing;
    what comes later is dropped); replaced by the next list; stalled (all chunks but no end); open. ``until`` tells up to
    when a silence at a transfer's end is known. ``seq`` is a whole number that orders a transfer's messages totally. What
    is no JSON object, or a list whose files aren't objects with a number as their size, is dropped like any message
    unknown; an absent number of chunks counts as 0. A null key is a key; an empty table gives no rows.
    """
    from .transfer import running

    said = F.from_json("json", META)
    is_meta = (said["type"] == "meta") & said["files"].isNotNull() & F.forall(said["files"], lambda f: f.isNotNull() & f["size"].isNotNull())
    binary = F.col("kind") == "binary"
    ms = F.unix_millis(F.col(at).cast("timestamp")) if at else F.lit(None).cast("long")
    rows = events.select(
        key_of([key]).alias("_of"),
        F.col(seq).cast("long").alias("_place"),
        F.when(binary, F.coalesce("byte_len", F.lit(0)).cast("long")).alias("_size"),
        F.when(~binary & is_meta, F.transform(said["files"], lambda f: f["size"].cast("long"))).alias("_sizes"),
        F.when(~binary & is_meta, F.coalesce(said["totalChunks"], F.lit(0)).cast("long")).alias("_total"),
        F.when(~binary & said["type"].isin("done", "abort"), said["type"]).alias("_end"),
        ms.alias("_ms"),
    )
    rows = rows.where("_size IS NOT NULL OR _sizes IS NOT NULL OR _end IS NOT NULL").withColumn("_is_end", F.col("_end").isNotNull())
    rows = running(rows, "_of", "_place", {"_list": F.col("_sizes").isNotNull().cast("int")}).where("_list > 0")
    run = Window.partitionBy("_of", "_list").orderBy("_place")
    rows = rows.withColumn("_ended", F.max("_is_end").over(run.rowsBetween(Window.unboundedPreceding, -1))).where("NOT coalesce(_ended, false)").drop("_ended")
    told = taken(rows, gap_ms=gap_ms, timed=at is not None)
    files = told.groupBy("_of", "_list", "_file").agg(
        F.sum("_size").alias("b"),
        F.count("_file").alias("c"),
        F.max("_sizes").alias("_sizes"),
        F.max("_total").alias("_total"),
        F.max("_end").alias("_end"),
        F.min("_gone_ms").alias("_gone_ms"),
        F.max(F.when(F.col("_file").isNotNull() | F.col("_sizes").isNotNull(), F.col("_ms"))).alias("_last"),
        F.min(F.when(F.col("_sizes").isNotNull(), F.col("_ms"))).alias("_began"),
    )
    each = F.map_from_entries(F.collect_list(F.when(F.col("_file").isNotNull(), F.struct("_file", "b"))))
    runs = files.groupBy("_of", "_list").agg(
        each.alias("_bytes"), F.sum("c").alias("_done"), *[F.max(c).alias(c) for c in ("_sizes", "_total", "_end", "_last", "_began")], F.min("_gone_ms").alias("_gone_ms")
    )
    next_ = F.lead("_began").over(Window.partitionBy("_of").orderBy("_list"))
    later = F.lead("_list").over(Window.partitionBy("_of").orderBy("_list")).isNotNull()
    runs = runs.withColumns({"_later": later, "_known": F.coalesce(next_, F.unix_millis(until) if until is not None else F.lit(None).cast("long"))})
    silent = (F.col("_known") - F.col("_last") > gap_ms) if at else F.lit(False)
    state = (
        F.when(F.col("_gone_ms").isNotNull(), F.lit("timed out"))
        .when(F.col("_end") == "done", F.lit("completed"))
        .when(F.col("_end") == "abort", F.lit("aborted"))
        .when(silent & (F.col("_done") < F.col("_total")), F.lit("timed out"))
        .when(F.col("_later"), F.lit("replaced"))
        .when(F.col("_done") >= F.col("_total"), F.lit("stalled"))
        .otherwise(F.lit("open"))
    )
    places = F.transform("_sizes", lambda _, i: F.coalesce(F.try_element_at("_bytes", i), F.lit(0)))
    return runs.select(
        F.col("_of.k0").alias(key), (F.col("_list") - 1).alias("number"), state.alias("state"), F.col("_done").alias("chunks_done"), F.col("_total").alias("chunks_total"), (F.col("_done") == F.col("_total")).alias("count_matches"), places.alias("file_bytes")
    )
