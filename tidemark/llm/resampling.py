"""Importance resampling of documents towards a target corpus, by postings of hashed features.

A document's features are hashed into buckets. Postings (bucket, document, count) are gathered in blocks of documents,
written once, and shuffled by range of buckets; a range is dealt over as many splits as there are blocks for, so a bucket
that every document has is read by many tasks. With the postings of a range come what both corpora hold in its buckets: a
task computes the gains of these buckets by itself and emits what they contribute to each document of a block. A second
shuffle, by block, adds the contributions up. Only the two grand totals go through the driver.

Gains, weights and scores are whole numbers, so sums do not depend on their order. Ranks come from sorting by range and
numbering each part; no task sees all rows.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import Workspace, ship
from .text import Texts, slices, small

#: Ranges of buckets, and blocks (about 2 MiB of text each) of a range that a task reads.
RANGES, SPLIT_BLOCKS = 32, 512
#: Documents with fewer words aren't drawn.
MIN_WORDS = 20
#: The words of both corpora: ASCII letters and digits, and every byte beyond ASCII.
_ACCEPT = np.zeros(256, dtype=bool)
_ACCEPT[48:58] = _ACCEPT[65:91] = _ACCEPT[97:123] = _ACCEPT[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Longer features are hashed one by one.
_LONG = 64


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


_CRC = _crc_table()


def crc32(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 of each data[start:end], byte by byte for all at once."""
    size = end - start
    order = np.argsort(-size, kind="stable")
    out = np.zeros(len(start), dtype=np.uint32)
    n_long = int(np.count_nonzero(size > _LONG))
    for i in order[:n_long].tolist():
        out[i] = zlib.crc32(data[start[i] : end[i]].tobytes())
    order = order[n_long:]
    at, left = start[order], size[order]
    crc = np.full(len(order), 0xFFFFFFFF, dtype=np.uint32)
    for k in range(int(left[0]) if len(left) else 0):
        n = int(np.searchsorted(-left, -k, side="left"))  # those longer than k come first
        crc[:n] = _CRC[(crc[:n] ^ data[at[:n] + k]) & 255] ^ (crc[:n] >> 8)
    out[order] = ~crc
    return out


def features(texts: Texts, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The document number and the CRC-32 of each feature: every run of 1 to ``most`` words, joined by one space."""
    data, n = texts.data, len(texts.data)
    inside = _ACCEPT[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    cut = texts.offsets[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    begins[cut] |= inside[cut]
    ends[cut - 1] |= inside[cut - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    doc = np.searchsorted(texts.offsets[1:], start, side="right")
    data = _LOWER[data]
    if most > 1 and len(start):  # words side by side with one space after each
        size = end - start + 1
        new = np.concatenate([[0], np.cumsum(size)])
        side = np.full(new[-1], 32, dtype=np.uint8)
        here = np.arange(new[-1]) - np.repeat(new[:-1], size)
        kept = here < np.repeat(size - 1, size)
        side[kept] = data[(np.repeat(start, size) + here)[kept]]
        data, start, end = side, new[:-1], new[1:] - 1
    docs, hashes = [], []
    for k in range(most):
        same = np.flatnonzero(doc[k:] == doc[: len(doc) - k]) if k < len(doc) else np.zeros(0, dtype=np.int64)
        docs.append(doc[same])
        hashes.append(crc32(data, start[same], end[same + k]))
    return np.concatenate(docs), np.concatenate(hashes)


def _bounds(buckets: int) -> np.ndarray:
    """The first bucket of each range, and the end."""
    return np.linspace(0, buckets, RANGES + 1).astype(np.int64)


def _posted(most: int, buckets: int):
    """Blocks: a row of ids and feature counts (range -1), and a row of postings for each range that the block has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, bounds = TaskContext.get().partitionId() << 32, _bounds(buckets)
        for batch in small(batches, 4096):
            kind = batch.schema.field(0).type
            names = ["block", "range", "ids", "n_features", "sizes", "docs", "counts"]
            kinds = [pa.int64(), pa.int32(), pa.list_(kind), pa.list_(pa.int64()), *[pa.binary()] * 3]
            for first, texts in slices(batch.column(1)):
                doc, hashed = features(texts, most)
                totals = np.bincount(doc, minlength=len(texts))
                # Features of a document and bucket are counted, and lie by bucket and then by document.
                key, counts = np.unique((hashed % buckets).astype(np.int64) * len(texts) + doc, return_counts=True)
                bucket, doc = np.divmod(key, len(texts))
                rows = [(block, -1, batch.column(0).slice(first, len(texts)).to_pylist(), totals.tolist(), None, None, None)]
                cuts = np.searchsorted(bucket, bounds)
                for r, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                    if a < b:
                        sizes = np.bincount(bucket[a:b] - bounds[r], minlength=bounds[r + 1] - bounds[r])
                        narrow = "<u1" if counts[a:b].max() < 256 else "<u4"
                        rows.append((block, r, None, None, sizes.astype("<u4").tobytes(), doc[a:b].astype("<u2").tobytes(), counts[a:b].astype(narrow).tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                block += 1

    return run


def _wide(counts: bytes, docs: bytes) -> np.ndarray:
    return np.frombuffer(counts, dtype="<u1" if 2 * len(counts) == len(docs) else "<u4").astype(np.int64)


def _sums(buckets: int):
    """What a task's postings hold in each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, bounds = np.zeros(buckets, dtype=np.int64), _bounds(buckets)
        for batch in batches:
            for r, sizes, docs, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                each = np.repeat(np.arange(bounds[r], bounds[r + 1]), np.frombuffer(sizes, dtype="<u4"))
                np.add.at(total, each, _wide(counts, docs))
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(total[found])], names=["bucket", "n"])

    return run


def gains(s: list[int], t: list[int], all_s: int, all_t: int, buckets: int) -> np.ndarray:
    """floor(1000 ln) of how much likelier a bucket is in the target than in the documents, with one added to each bucket."""
    ratio = lambda x, y: float(y + 1) * float(all_s + buckets) / (float(x + 1) * float(all_t + buckets))
    return np.array([math.floor(1000 * math.log(ratio(x, y))) for x, y in zip(s, t, strict=True)], dtype=np.int64)


def _contributed(all_s: int, all_t: int, buckets: int):
    """Each range's totals come before its postings, which then give their part of each document's weight."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain, of = None, None
        for batch in batches:
            blocks, parts = [], []
            for block, r, split, sizes, docs, counts, s, t in zip(*(batch.column(c).to_pylist() for c in ("block", "range", "split", "sizes", "docs", "counts", "s", "t")), strict=True):
                if block is None:
                    gain, of = gains(s, t, all_s, all_t, buckets), (r, split)
                    continue
                assert of == (r, split)
                places = np.frombuffer(docs, dtype="<u2")
                each = np.repeat(gain, np.frombuffer(sizes, dtype="<u4")) * _wide(counts, docs)
                sums = np.zeros(int(places.max()) + 1, dtype="<i8")
                np.add.at(sums, places, each)
                blocks.append(block)
                parts.append(sums.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array(parts, pa.binary())], names=["block", "sums"])

    return run


def _weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each block's ids come before the contributions to its documents."""
    held = None

    def told() -> pa.RecordBatch:
        block, ids, n, sums = held
        columns = [pa.array([block] * len(ids), pa.int64()), pa.array(range(len(ids)), pa.int32()), ids, pa.array(n, pa.int64()), pa.array(sums)]
        return pa.RecordBatch.from_arrays(columns, names=["block", "place", "id", "n_features", "weight"])

    for batch in batches:
        for i, (block, sums) in enumerate(zip(batch.column("block").to_pylist(), batch.column("sums").to_pylist(), strict=True)):
            if sums is None:
                if held is not None:
                    yield told()
                ids = batch.column("ids")[i].values
                held = block, ids, batch.column("n_features")[i].values, np.zeros(len(ids), dtype=np.int64)
            else:
                assert held[0] == block
                part = np.frombuffer(sums, dtype="<i8")
                held[3][: len(part)] += part
    if held is not None:
        yield told()


def _count(rows: DataFrame, most: int, buckets: int, work: Workspace, name: str) -> DataFrame:
    """Written postings of rows (id, text)."""
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"block long, range int, ids array<{kind}>, n_features array<long>, sizes binary, docs binary, counts binary"
    return work.save(rows.mapInArrow(_posted(most, buckets), schema), name)


def _totals(postings: DataFrame, buckets: int) -> DataFrame:
    """``bucket``, ``n``: at most as many rows as there are buckets, summed within tasks first."""
    part = postings.where("range >= 0").select("range", "sizes", "docs", "counts").mapInArrow(_sums(buckets), "bucket int, n long")
    return part.groupBy("bucket").agg(F.sum("n").alias("n"))


def weights(docs: DataFrame, target: DataFrame, work: Workspace, *, most: int, buckets: int, id_col: str, text_col: str) -> DataFrame:
    """Written rows (block, place, id, n_features, weight), one for each document."""
    spark = docs.sparkSession
    ship(spark)
    text = lambda df, c: df.select(F.col(c).alias("id"), F.col(text_col).alias("text"))
    postings = _count(text(docs, id_col), most, buckets, work, "postings")
    wanted = _count(target.select(F.lit(0).alias("id"), F.col(text_col).alias("text")), most, buckets, work, "target")
    bounds = _bounds(buckets).tolist()
    every = spark.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    both = every.join(_totals(postings, buckets).withColumnRenamed("n", "s"), "bucket", "left").join(_totals(wanted, buckets).withColumnRenamed("n", "t"), "bucket", "left")
    range_of = F.size(F.filter(F.array(*map(F.lit, bounds[1:])), lambda b: b <= F.col("bucket")))
    both = work.save(both.select(range_of.alias("range"), "bucket", F.coalesce("s", F.lit(0)).alias("s"), F.coalesce("t", F.lit(0)).alias("t")), "totals")
    all_s, all_t = (int(x or 0) for x in both.agg(F.sum("s"), F.sum("t")).first())
    splits = postings.where("range < 0").count() // SPLIT_BLOCKS + 1
    listed = F.array_sort(F.collect_list(F.struct("bucket", "s", "t")))
    known = both.groupBy("range").agg(listed.alias("_l")).select("range", F.col("_l.s").alias("s"), F.col("_l.t").alias("t"))
    known = known.withColumn("split", F.explode(F.sequence(F.lit(0), F.lit(splits - 1))))
    posted = postings.where("range >= 0").drop("ids", "n_features").withColumn("split", F.pmod(F.xxhash64("block"), F.lit(splits)).cast("int"))
    met = posted.unionByName(known, allowMissingColumns=True).repartition("range", "split").sortWithinPartitions("range", "split", F.col("block").asc_nulls_first())
    parts = met.mapInArrow(_contributed(all_s, all_t, buckets), "block long, sums binary")
    heads = postings.where("range < 0").select("block", "ids", "n_features")
    laid = heads.unionByName(parts, allowMissingColumns=True).repartition("block").sortWithinPartitions("block", F.col("sums").isNotNull())
    kind = docs.schema[id_col].dataType.simpleString()
    return work.save(laid.mapInArrow(_weighed, f"block long, place int, id {kind}, n_features long, weight long"), "weights")


def noise(id_: Column, seed: int) -> Column:
    """floor(-1000 ln(-ln u)) of a u in (0, 1) that depends on the seed and the id alone; a null id counts as no text."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))), 256), 1, 8)
    u = (F.conv(digits, 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(F.log(-F.log(u)) * -1000.0).cast("long")


def resample(docs: DataFrame, target: DataFrame, *, most: int = 1, buckets: int = 10_000, percent: int = 10, seed: int = 2024, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's ``n_features``, ``weight``, ``score`` and ``rank``, the place among those drawn, else null.

    Words are runs of ASCII letters and digits and of all characters beyond ASCII, A-Z in lower case; features are runs of 1
    to ``most`` words. The weight sums the gains of a document's features, the score adds noise to it, and of N documents
    with at least ``min_words`` features the floor(percent * N / 100) of the highest scores are drawn, ties to smaller ids.

    Null and empty texts have no features and the weight 0. Each row is a document, also where ids or rows repeat; equal
    rows rank one after the other. A null id ranks after others of its score. An empty target has no features, so a bucket
    that the documents have most of gains least. Other columns are not read; an empty table gives no rows.
    """
    work = Workspace(docs.sparkSession, "resampling")
    rows = weights(docs, target, work, most=most, buckets=buckets, id_col=id_col, text_col=text_col)
    scored = rows.withColumn("score", F.col("weight") + noise(F.col("id"), seed)).withColumn("late", (F.col("n_features") < min_words).cast("int"))
    order = [F.col("late").asc(), F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("block").asc(), F.col("place").asc()]
    # Each part of the sorted table numbers its rows; the parts' sizes tell how many come before. Parts are few, rows many.
    laid = scored.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    laid = work.save(laid.select("id", "n_features", "weight", "score", "late", F.shiftright("_at", 33).cast("int").alias("part"), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)).alias("at")), "sorted")
    sizes = laid.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum(1 - F.col("late")).alias("many"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    drawn = (sizes.agg(F.sum("many")).first()[0] or 0) * percent // 100
    place = F.col("before") + F.col("at") + 1
    out = laid.join(F.broadcast(before), "part")
    return work.finish(out.select(F.col("id").alias(id_col), "n_features", "weight", "score", F.when(place <= drawn, place).alias("rank")))


#: CRC-32 from its table, once for each distinct word.
ORACLE = r"""
WITH tab AS (SELECT list(list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY i) AS t FROM (SELECT unnest(range(256)) AS i)),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark),
f AS (SELECT r, unnest(w) AS word FROM d),
v AS (SELECT word, xor(4294967295, list_reduce(list_concat([4294967295], list_transform(range(1, 1 + strlen(word)), lambda i: CAST('0x' || substr(hex(encode(word)), 2 * i - 1, 2) AS BIGINT))),
        lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]))) % 10000 AS bucket FROM (SELECT word FROM f UNION SELECT word FROM b), tab),
s AS (SELECT bucket, count(*) AS s FROM f JOIN v USING (word) GROUP BY 1), t AS (SELECT bucket, count(*) AS t FROM b JOIN v USING (word) GROUP BY 1),
n AS (SELECT (SELECT count(*) FROM f) AS s, (SELECT count(*) FROM b) AS t),
g AS (SELECT bucket, CAST(floor(1000 * ln(CAST(coalesce(t.t, 0) + 1 AS DOUBLE) * (n.s + 10000) / (CAST(s.s + 1 AS DOUBLE) * (n.t + 10000)))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (bucket), n),
w AS (SELECT r, sum(gain) AS weight FROM f JOIN v USING (word) JOIN g USING (bucket) GROUP BY 1),
x AS (SELECT r, doc_id, len(w) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight, CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) AS h FROM d LEFT JOIN w USING (r)),
y AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM x),
z AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM y WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * n // 100 THEN rank END AS rank FROM y LEFT JOIN z USING (r)
"""
