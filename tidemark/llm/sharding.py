"""Shards within a byte limit, by extendible hashing.

The directory is indexed by the leading bits of a key's hash. A bucket is split on one more bit only while it is over
the limit, so its depth is the least at which the rows that share its bits fit. Rows are summed once in cells a few bits
finer than the mean shard. Then buckets are split a few bits at a time: those that fit are done, and only the cells of
oversized ones go on. Cells that are over the limit themselves go on with deeper bits.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Workspace, join_by_key

#: Hash bits used; a bucket of rows with one hash can't be split by them.
BITS = 60
#: How much finer than the mean shard cells are, in bits; also the bits by which oversized buckets are split at a time.
FINER = 6


def hash_bits(key: Column) -> Column:
    """The first 60 bits of a key's MD5 as a number; null counts as the empty text."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, BITS // 4), 16, 10).cast("long")


def _prefix(hash_: Column, depth: Column) -> Column:
    return F.call_function("shiftright", hash_, (F.lit(BITS) - depth).cast("int"))


def _split(cells: DataFrame, limit: int, low: int, fine: int, work: Workspace) -> DataFrame:
    """cells (group, cell of ``fine`` bits, bytes, h0, h1) with ``depth``, from ``low`` bits on; null if none fits."""
    done: DataFrame | None = None
    while True:
        high = min(low + FINER, fine)
        top = cells.withColumn("top", F.call_function("shiftright", "cell", F.lit(fine - high)))
        tops = top.groupBy("group", "top").agg(F.sum("bytes").alias("bytes"), F.min("h0").alias("h0"), F.max("h1").alias("h1"))
        each = tops.withColumn("depth", F.explode(F.sequence(F.lit(low), F.lit(high))))
        each = each.withColumn("prefix", F.call_function("shiftright", "top", F.lit(high) - F.col("depth")))
        sums = each.groupBy("group", "depth", "prefix").agg(F.sum("bytes").alias("bytes"), F.min("h0").alias("h0"), F.max("h1").alias("h1"))
        fits = sums.where((F.col("bytes") <= limit) | (F.col("h0") == F.col("h1"))).select("group", "depth", "prefix")
        least = each.join(fits, ["group", "depth", "prefix"]).groupBy("group", "top").agg(F.min("depth").alias("depth"))
        told = work.save(top.join(least, ["group", "top"], "left").drop("top"), "split")
        part = told if high == fine else told.where("depth IS NOT NULL")
        done = part if done is None else done.unionByName(part)
        cells, low = told.where("depth IS NULL").drop("depth"), high + 1
        if high == fine or cells.isEmpty():
            return done


def _depths(sized: DataFrame, limit: int, work: Workspace) -> DataFrame:
    """(group, hash, depth, n) of each distinct hash in (group, hash, bytes, n): split within groups."""
    total = sized.agg(F.sum("bytes")).first()[0] or 0
    low, fine, found = 0, min(BITS, max(0, math.ceil(math.log2(max(1, total / limit)))) + FINER), None
    while True:
        cells = sized.groupBy("group", _prefix(F.col("hash"), F.lit(fine)).alias("cell"))
        cells = work.save(cells.agg(F.sum("bytes").alias("bytes"), F.min("hash").alias("h0"), F.max("hash").alias("h1")), "cells")
        depth = _split(cells, limit, low, fine, work).select("group", "cell", "depth")
        keyed = sized.withColumn("cell", _prefix(F.col("hash"), F.lit(fine))).join(depth, ["group", "cell"])
        keyed = work.save(keyed.select("group", "hash", "bytes", "n", "depth"), "keyed")
        part = keyed.where("depth IS NOT NULL").select("group", "hash", "n", "depth")
        found = part if found is None else found.unionByName(part)
        sized = keyed.where("depth IS NULL").drop("depth")
        if fine >= BITS or sized.isEmpty():
            return found
        low, fine = fine + 1, min(BITS, fine + FINER)


def assign(docs: DataFrame, *, byte_limit: int = 1 << 20, key_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The key and ``shard`` of each row, with ``depth``, ``shard_bytes``, ``shard_docs`` and ``fits``.

    A shard's name is its directory bits, empty for one shard of all. Null and empty texts have no bytes. Equal keys
    share a bucket until it can't be split by the key: if such a bucket is over the limit, its rows are dealt further
    by a hash of each row's number, and the name goes on with "+" and those bits. One row over the limit has a shard
    of its own that doesn't fit. Null keys count as one key. Other columns are not read; an empty table gives no rows.
    """
    work = Workspace(docs.sparkSession, "shards")
    size = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long")
    rows = docs.select(F.col(key_col).alias("key"), hash_bits(F.col(key_col)).alias("hash"), size.alias("bytes"), F.monotonically_increasing_id().alias("row"))
    rows = work.save(rows, "rows")
    sized = rows.groupBy(F.lit("").alias("group"), "hash").agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("n"))
    depths = work.save(_depths(work.save(sized, "sized"), byte_limit, work).select("hash", "depth", "n"), "depths")
    named = join_by_key(rows, depths, ["hash"], "row").withColumn("shard", _bits(F.col("hash"), F.col("depth")))
    named = work.save(named, "named")
    over = named.groupBy("shard").agg(F.sum("bytes").alias("b"), F.count(F.lit(1)).alias("n")).where((F.col("b") > byte_limit) & (F.col("n") > 1))
    over = work.save(over.drop("b"), "over")
    if not over.isEmpty():
        again = join_by_key(named, over, ["shard"], "row").withColumn("h2", hash_bits(F.concat_ws(" ", "hash", "row")))
        again = work.save(again, "again")
        pages = _depths(again.groupBy(F.col("shard").alias("group"), F.col("h2").alias("hash")).agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("n")), byte_limit, work)
        pages = pages.select(F.col("group").alias("shard"), F.col("hash").alias("h2"), F.col("depth").alias("more"))
        again = again.join(pages, ["shard", "h2"])
        again = again.withColumn("shard", F.concat("shard", F.lit("+"), _bits(F.col("h2"), F.col("more")))).withColumn("depth", F.col("depth") + F.col("more"))
        named = named.join(over.select("shard"), "shard", "left_anti").unionByName(again.select(*named.columns))
    totals = work.save(named.groupBy("shard").agg(F.sum("bytes").alias("shard_bytes"), F.count(F.lit(1)).alias("shard_docs"), F.count(F.lit(1)).alias("n")), "totals")
    out = join_by_key(named, totals, ["shard"], "row")
    return work.finish(out.select(F.col("key").alias(key_col), "shard", "depth", "shard_bytes", "shard_docs", (F.col("shard_bytes") <= byte_limit).alias("fits")))


def directory(assigned: DataFrame) -> DataFrame:
    """The directory of a result of ``assign``: a row for each shard with its ``bits`` (those of its bucket), ``local_depth``,
    ``global_depth`` (the longest of all), and ``first_slot`` and ``last_slot``, the entries that point to it. Entries of no key point to no shard."""
    shards = assigned.groupBy("shard").agg(F.first("shard_bytes").alias("shard_bytes"), F.first("shard_docs").alias("shard_docs"))
    shards = shards.withColumn("bits", F.split("shard", r"\+")[0]).withColumn("local_depth", F.length("bits"))
    deepest = shards.agg(F.max("local_depth").alias("d"))
    free = F.col("global_depth") - F.col("local_depth")
    first = F.call_function("shiftleft", F.coalesce(F.conv("bits", 2, 10).cast("long"), F.lit(0)), free.cast("int"))
    shards = shards.withColumn("global_depth", deepest.scalar()).withColumn("first_slot", first)
    return shards.withColumn("last_slot", F.col("first_slot") + F.call_function("shiftleft", F.lit(1).cast("long"), free.cast("int")) - 1)


def shards_of(keys: DataFrame, table: DataFrame, *, key_col: str = "doc_id") -> DataFrame:
    """Rows with the ``shard`` that a directory gives their key: one, or each page of a bucket of one hash.

    A key is tried at the local depths that there are (61 at most), so this is a join on bits and no scan of slots."""
    depths = table.agg(F.array_sort(F.collect_set("local_depth")).alias("d")).scalar()
    tried = keys.withColumn("_depth", F.explode(depths)).withColumn("bits", _bits(hash_bits(F.col(key_col)), F.col("_depth")))
    return tried.join(table.select("bits", "shard"), "bits").drop("bits", "_depth")


def _bits(hash_: Column, depth: Column) -> Column:
    named = F.lpad(F.bin(_prefix(hash_, depth)), depth.cast("int"), F.lit("0"))
    return F.when(depth == 0, F.lit("")).otherwise(named)


ORACLE = """
WITH d AS (SELECT doc_id, strlen(coalesce(text, '')) AS b, CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT) AS h FROM documents),
pre AS (SELECT k, h >> (60 - k) AS p, sum(b) AS s, count(*) AS n, min(h) AS lo, max(h) AS hi FROM d, (SELECT unnest(range(0, 61)) AS k) GROUP BY ALL),
best AS (SELECT d.doc_id, d.h, min(pre.k) AS k FROM d JOIN pre ON pre.p = d.h >> (60 - pre.k) WHERE pre.s <= 1048576 OR pre.lo = pre.hi GROUP BY ALL)
SELECT best.doc_id, CASE WHEN best.k = 0 THEN '' ELSE lpad(bin(pre.p), CAST(best.k AS INTEGER), '0') END AS shard, CAST(best.k AS INTEGER) AS depth,
       CAST(pre.s AS BIGINT) AS shard_bytes, pre.n AS shard_docs, pre.s <= 1048576 AS fits
FROM best JOIN pre ON pre.k = best.k AND pre.p = best.h >> (60 - best.k)
"""
