"""MinHash near-duplicate groups: one-permutation hashing, banded buckets, star-shaped candidate edges.

1. One pass over the texts makes, per document, the size and a 128-bit digest of its shingle set and its band keys.
   Documents with equal sets form a class at once (a partial aggregate, so a group of copies of any size costs
   little); its least id stands for it from there on.
2. Representatives that share a band key share a bucket. Each bucket gets one centre, the member that meets the most
   others over all bands (in a group of edited copies that is the text the others derive from), and offers one
   candidate pair per other member: pairs grow with the members, not with their square.
3. Candidates are confirmed on the full shingle sets, and confirmed links joined to components.
4. Where a bucket still holds members of different components, the links that a star can't see are looked for by
   their rare shingles: of a linked pair, the least frequent common shingle is among the rarest few of both (prefix
   filtering), so no link is lost, and texts that share frequent shingles only make no pair. A bucket of up to so many
   shingles and bytes is searched within a task; the members of larger ones are joined on their rare shingles.

Buckets, centres and groups of copies are joined with their hot keys dealt out over tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from . import minhash, text
from .components import components
from .shared import FEW_ROWS, HOT, Workspace, join_by_key, ship

#: Shingles of a bucket's members, in all, and bytes of their texts, that are searched within one task.
BLOCK_SHINGLES, BLOCK_BYTES = 1 << 21, 1 << 26


def _sign(size: int, rows: int, bands: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text.small(batches):
            for at, part in text.slices(batch.column(1)):
                sets, bounds = text.shingle_sets(text.words(part), size)
                n = np.diff(bounds)
                low, high = (np.add.reduceat(np.append(x, text.U(0)), np.minimum(bounds[:-1], len(x))) if len(x) else np.zeros(len(n), text.U) for x in (text.mix(sets), text.mix(sets ^ text.U(0x5851F42D4C957F2D))))
                keys = minhash.band_keys(minhash.signatures(sets, bounds, rows * bands), rows, bands)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * bands), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(n)), pa.array(n.astype(np.int64)), pa.array(np.diff(part.offsets).astype(np.int64)), pa.array(low.view(np.int64)), pa.array(high.view(np.int64)), lists],
                    names=["id", "n", "bytes", "low", "high", "keys"],
                )

    return run


def _linked(size_a, size_b, common, num: int, den: int):
    return den * common >= num * (size_a + size_b - common)


def _verify(size: int, num: int, den: int):
    """Rows of ids and texts a, b; gives back the ids whose shingle sets are alike enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sides = []
                for column in (2, 3):
                    pieces = [text.shingle_sets(text.words(x), size) for _, x in text.slices(part.column(column))]
                    sizes = np.concatenate([np.diff(b) for _, b in pieces])
                    sides.append((np.concatenate([s for s, _ in pieces]), sizes))
                (sa, na), (sb, nb) = sides
                pair = np.concatenate([np.repeat(np.arange(len(na)), na), np.repeat(np.arange(len(nb)), nb)])
                both = np.concatenate([sa, sb])
                order = np.lexsort((both, pair))
                both, pair = both[order], pair[order]
                twice = (both[1:] == both[:-1]) & (pair[1:] == pair[:-1])
                common = np.bincount(pair[1:][twice], minlength=len(na))
                keep = pa.array(_linked(na, nb, common, num, den) & (na > 0))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], names=["a", "b"]).filter(keep)

    return run


def _prefixes(n, num: int, den: int):
    """How many of a set's first shingles in the common order may hold the first that it shares with a linked set: one
    no smaller, and one no larger."""
    return n - (2 * num * n + (num + den - 1)) // (num + den) + 1, n - (num * n + den - 1) // den + 1


def _search(size: int, num: int, den: int):
    """Links between the components in a bucket of bounded size, at most one for each component that is joined."""

    def run(rows: pa.Table) -> pa.Table:
        ids, comp = (rows[c].to_numpy() for c in ("doc", "comp"))
        pieces = [text.shingle_sets(text.words(x), size) for _, x in text.slices(rows["text"])]
        sizes = np.concatenate([np.diff(b) for _, b in pieces])
        sets, bounds = np.concatenate([s for s, _ in pieces]), np.concatenate([[0], np.cumsum(sizes)])
        # In order of their sizes, so that the later of two entries is of the set that isn't smaller.
        order = np.argsort(sizes, kind="stable")
        owner = np.repeat(np.argsort(order).astype(np.int32), sizes)
        ids, comp, sizes, start, end = ids[order], comp[order], sizes[order], bounds[:-1][order], bounds[1:][order]
        _, back, times = np.unique(sets, return_inverse=True, return_counts=True)
        rank = np.empty(len(times), dtype=np.int32)
        rank[np.argsort(times, kind="stable")] = np.arange(len(times), dtype=np.int32)
        shingle, often = rank[back], times[back] > 1
        del back, rank, times
        by_set = np.lexsort((shingle, owner))
        place = np.empty(len(sets), dtype=np.int32)
        place[by_set] = np.arange(len(sets), dtype=np.int32) - np.repeat((np.cumsum(sizes) - sizes).astype(np.int32), sizes)
        del by_set
        near, far = _prefixes(sizes, num, den)
        kept = np.flatnonzero(often & (place < far[owner]))
        kept = kept[np.lexsort((owner[kept], shingle[kept]))]
        own, at, shingle = owner[kept].astype(np.int64), place[kept], shingle[kept]
        last = np.searchsorted(shingle, shingle, side="right")
        del owner, place, often, kept, shingle
        root = {c: c for c in comp.tolist()}

        def find(c):
            while root[c] != c:
                c = root[c]
            return c

        out, left = [], np.flatnonzero((at < near[own]) & (np.arange(len(own)) + 1 < last))
        step, seen = 0, np.zeros(0, dtype=np.int64)
        while len(left):
            step += 1
            i, j = own[left], own[left + step]
            most = np.minimum(sizes[i] - at[left], sizes[j] - at[left + step])
            fit = (comp[i] != comp[j]) & (den * sizes[i] >= num * sizes[j]) & ((num + den) * most >= num * (sizes[i] + sizes[j]))
            pairs = np.setdiff1d(i[fit] * len(ids) + j[fit], seen)
            seen = np.union1d(seen, pairs)
            for i, j in zip((pairs // len(ids)).tolist(), (pairs % len(ids)).tolist(), strict=True):
                a, b = find(comp[i].item()), find(comp[j].item())
                if a != b:
                    common = len(np.intersect1d(sets[start[i] : end[i]], sets[start[j] : end[j]], assume_unique=True))
                    if _linked(sizes[i], sizes[j], common, num, den):
                        root[max(a, b)] = min(a, b)
                        out.append((ids[i], ids[j]))
            left = left[left + step + 1 < last[left]]
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    return run


def _list_shingles(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, part in text.slices(batch.column(2)):
                sets, bounds = text.shingle_sets(text.words(part), size)
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(sets.view(np.int64)))
                yield pa.RecordBatch.from_arrays([*(c.slice(at, len(part)) for c in batch.columns[:2]), pa.array(np.diff(bounds)), lists], names=["doc", "comp", "n", "shingles"])

    return run


def rare_pairs(members: DataFrame, size: int, num: int, den: int, work: Workspace) -> DataFrame:
    """``a``, ``b``: pairs of members (doc, comp, text) of different components that may be linked; no link is missing.

    It is what a task does for a bucket, as a join: entries of the rarest shingles of both, by the places that
    ``_prefixes`` tells; the places also bound how much the two can share.
    """
    sets = work.save(members.mapInArrow(_list_shingles(size), "doc long, comp long, n long, shingles array<long>"), "sets")
    each = sets.select("doc", "comp", "n", F.explode("shingles").alias("s"))
    often = each.groupBy("s").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    often = work.save(often.withColumn("rows", F.col("df")), "often")
    known = join_by_key(each, often, ["s"], "doc", n="rows").groupBy("doc", "comp", "n").agg(F.array_sort(F.collect_list(F.struct("df", "s"))).alias("t"))
    placed = known.select("doc", "comp", "n", (F.col("n") - F.size("t")).alias("alone"), F.posexplode("t").alias("k", "t"))  # those of one set come first
    placed = placed.select("doc", "comp", "n", F.col("t.s").alias("s"), (F.col("alone") + F.col("k")).alias("at"))
    up_to = lambda p, q: F.col("n") - F.call_function("div", F.col("n") * p + (q - 1), F.lit(q)) + 1
    larger = work.save(placed.where(F.col("at") < up_to(num, den)), "placed")
    smaller = larger.where(F.col("at") < up_to(2 * num, num + den)).select("s", *(F.col(c).alias(f"{c}0") for c in ("doc", "comp", "n", "at")))
    least = F.least(F.col("n0") - F.col("at0"), F.col("n") - F.col("at"))
    fits = (F.col("comp") != F.col("comp0")) & (den * F.col("n0") >= num * F.col("n")) & ((num + den) * least >= num * (F.col("n0") + F.col("n")))
    first = (F.col("n0") < F.col("n")) | ((F.col("n0") == F.col("n")) & (F.col("doc0") < F.col("doc")))
    return smaller.join(larger, "s").where(fits & first).select(F.col("doc0").alias("a"), F.col("doc").alias("b")).distinct()


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """Groups of documents whose shingle sets have a likeness (intersection over union) of num/den or more.

    Words are the runs between ASCII white space after lower-casing A-Z. Gives one row for each input row: the id,
    ``n_shingles``, ``component_id`` (the least id reachable over links) and ``kept`` (it is that id itself).

    - A null or empty text, or one without words, has an empty set: linked with nothing, its own component.
    - A text of fewer words than a shingle has one shingle, its whole word sequence.
    - Rows that repeat an id are one document: each gets a row, in the same component, with the size of its own text.
    - A null id can't be linked: component null, kept true.
    - Ids of any type that has an order: those that aren't whole numbers are numbered in their order, and named again.
    - Other columns, whatever their names, are not read. An empty table gives no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    work = Workspace(spark, "near")
    if not isinstance(docs.schema[id_col].dataType, IntegralType):
        return _named(docs, work, id_col, text_col, {"shingle": shingle, "num": num, "den": den})
    rows, bands = minhash.banding(num, den)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    signed = work.save(texts.mapInArrow(_sign(shingle, rows, bands), "id long, n long, bytes long, low long, high long, keys array<long>"), "signed")
    named = signed.where("n > 0 AND id IS NOT NULL")
    classes = named.groupBy("low", "high").agg(F.min(F.struct("id", "keys", "bytes")).alias("r"), F.first("n").alias("size"), F.count(F.lit(1)).alias("members"))
    classes = work.save(classes.select("low", "high", "size", "members", F.col("r.id").alias("doc"), F.col("r.bytes").alias("bytes"), F.col("r.keys").alias("keys")), "classes")

    bucketed = classes.select("doc", F.explode("keys").alias("bucket"))
    shared = work.save(bucketed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumn("rows", F.col("n")), "shared")
    total = shared.agg(F.sum("n")).first()[0] or 0
    met = work.save(join_by_key(bucketed, shared, ["bucket"], "doc", n="rows", total=total), "met")
    score = met.groupBy("doc").agg(F.sum("n").alias("score"))
    ranked = met.join(score, "doc").groupBy("bucket").agg(F.max(F.struct("score", -F.col("doc"))).alias("top"), F.first("n").alias("n"))
    centres = work.save(ranked.select("bucket", "n", (-F.col("top.col2")).alias("centre")), "centres")
    starred = work.save(join_by_key(met.select("bucket", "doc"), centres, ["bucket"], "doc", total=total).where("doc <> centre"), "starred")
    pairs = starred.select(F.col("doc").alias("a"), F.col("centre").alias("b")).distinct()

    def confirmed(pairs: DataFrame) -> DataFrame:
        # A document is in few pairs as a, but a centre in as many as it has members: those are dealt out, and the centre's text goes to each part.
        pairs = work.save(pairs, "pairs")
        times = work.save(pairs.groupBy("b").agg(F.count(F.lit(1)).alias("times")), "times")
        share = max(FEW_ROWS, (times.agg(F.sum("times")).first()[0] or 0) // HOT)
        hot = F.broadcast(times.where(F.col("times") > share).select("b", F.ceil(F.col("times") / share).cast("int").alias("salts")))
        salted = pairs.join(hot, "b", "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("a"), F.col("salts")).cast("int"), F.lit(0))).drop("salts")
        left = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
        right = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")).join(hot, "b", "left")
        right = right.withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
        both = salted.join(left.hint("merge"), "a").join(right.hint("merge"), ["b", "salt"]).select("a", "b", "text_a", "text_b")
        return both.mapInArrow(_verify(shingle, num, den), "a long, b long")

    links = work.save(confirmed(pairs), "links").distinct()

    # Copies are linked with their representative by their class; only ids that repeat bring anything new.
    repeated = named.groupBy("id").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    same = named.join(repeated, "id", "left_semi").join(classes.select("low", "high", "doc"), ["low", "high"])
    links = links.unionByName(same.where("id <> doc").select(F.col("id").alias("a"), F.col("doc").alias("b")))
    grouped = components(links, work)

    rooted = classes.select("doc", "size", "bytes").join(grouped.withColumnRenamed("id", "doc"), "doc", "left").withColumn("comp", F.coalesce("comp", "doc"))
    found = work.save(starred.select("bucket", "doc").join(rooted.dropDuplicates(["doc"]), "doc"), "found")
    mixed = found.groupBy("bucket").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.count(F.lit(1)).alias("n"), F.sum("size").alias("sizes"), F.sum("bytes").alias("bytes")).where("c0 <> c1")
    mixed = work.save(mixed.select("bucket", "n", ((F.col("sizes") <= BLOCK_SHINGLES) & (F.col("bytes") <= BLOCK_BYTES)).alias("bounded")), "mixed")
    open_ = join_by_key(found.drop("size", "bytes"), mixed, ["bucket"], "doc")
    open_ = work.save(open_, "open")
    spoken = texts.select(F.col("id").alias("doc"), "text").hint("merge")
    within = open_.where("bounded").join(spoken, "doc").groupBy("bucket").applyInArrow(_search(shingle, num, den), "a long, b long")
    more = work.save(within, "more")
    crowded = open_.where("NOT bounded").select("doc", "comp").distinct()
    if not crowded.isEmpty():
        candidates = rare_pairs(crowded.join(spoken, "doc").select("doc", "comp", "text"), shingle, num, den, work)
        more = more.unionByName(work.save(confirmed(candidates), "rare"))
    # The components that such links join are few; only their ids are grouped anew.
    end = lambda side: grouped.select(F.col("id").alias(side), F.col("comp").alias(f"root_{side}"))
    joined = more.join(end("a"), "a", "left").join(end("b"), "b", "left")
    joined = joined.select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
    merged = components(joined, work).select(F.col("id").alias("root"), F.col("comp").alias("above"))

    member = _members(signed, classes)
    rooted = member.join(grouped.withColumnRenamed("id", "doc"), "doc", "left").withColumn("root", F.coalesce("comp", "doc"))
    comp = rooted.join(merged, "root", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("above", "root"))
    out = comp.select("id", "n", component.alias("component_id"))
    return work.finish(out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept")))


def _named(docs: DataFrame, work: Workspace, id_col: str, text_col: str, how: dict[str, int]) -> DataFrame:
    """``near_duplicates`` of ids that aren't whole numbers."""
    rows = work.save(docs.select(F.col(id_col).alias("name"), F.col(text_col).alias("text")), "rows")
    times = rows.where("name IS NOT NULL").groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    names = times.repartitionByRange("name").sortWithinPartitions("name").withColumn("number", F.monotonically_increasing_id())
    names = work.save(names, "names")
    numbered = join_by_key(rows, names, ["name"], "text", how="left").select("number", "text")
    told = near_duplicates(numbered, id_col="number", text_col="text", **how)
    back = join_by_key(told, names.withColumnRenamed("name", "_id"), ["number"], "n_shingles", how="left")
    groups = work.save(told.where("component_id IS NOT NULL").groupBy("component_id").agg(F.count(F.lit(1)).alias("n")).join(names.select(F.col("number").alias("component_id"), F.col("name").alias("_component")), "component_id"), "groups")
    back = join_by_key(back, groups, ["component_id"], "number", how="left")
    return work.finish(back.select(F.col("_id").alias(id_col), "n_shingles", F.col("_component").alias("component_id"), "kept"))


def _members(signed: DataFrame, classes: DataFrame) -> DataFrame:
    """Each row with the representative of its class; a class of one row needs no lookup."""
    copies = classes.where("members > 1").select("low", "high", "doc", "members")
    joined = join_by_key(signed.select("id", "n", "low", "high"), copies, ["low", "high"], "id", n="members", how="left")
    return joined.select("id", "n", F.when(F.col("id").isNotNull() & (F.col("n") > 0), F.coalesce("doc", "id")).otherwise(F.col("id")).alias("doc"))


#: The groups of 3-word shingles at 85 in 100 for DuckDB, by all pairs that share a shingle and all that is reached over links.
ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d),
s AS (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM g),
l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
c AS (SELECT a, min(b) AS b FROM r GROUP BY 1)
SELECT doc_id, CAST(len(g) AS BIGINT) AS n_shingles, least(doc_id, coalesce(b, doc_id)) AS component_id, coalesce(b >= doc_id, true) AS kept FROM g LEFT JOIN c ON c.a = doc_id
"""
