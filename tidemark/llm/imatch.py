"""I-Match document fingerprints, in DataFrame functions only.

The lexicon is made of the terms whose inverse document frequency over all documents lies in a band. A document's
distinct lexicon terms are sorted and hashed: once as they are, and once for each of several randomised subsets of the
lexicon, so that an edit changes only the hashes of subsets that hold an edited term. Subsets come in levels, each half
as dense as the one before and within it; a document uses those levels at which it has a few terms to a subset, so
short and long texts tell edits apart equally well. A text without a lexicon term has no subset's hash; it is told by
the hash of all its terms, and is like equal texts only.

The lexicon is held as the exact 64-bit hashes of its terms, dealt into buckets behind a bitmap of fixed size that most
other terms fail at once. By the band's lower end it has at most (mean number of distinct terms) / LOW terms, however
many documents there are; more than MOST of them are refused. It is written as a table of one row, which plans refer to
as a scalar subquery, so it never stands in a plan.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import Workspace

#: The band: lexicon terms are in at least LOW and at most HIGH of all documents (idf ln 1/HIGH to ln 1/LOW).
LOW, HIGH = 0.0005, 0.05
#: A lexicon term is in so many documents at least, however few there are: a word of one document tells nothing of others.
LEAST = 2
#: A lexicon of more terms isn't sent to tasks: 64 MiB of hashes, which texts of 4,194 distinct terms in the mean can't exceed.
MOST = 1 << 23
#: Bits of the lexicon's bitmap, as a power of two; 64 share a bucket of exact hashes.
SLOTS = 21
#: Hashes of a term, each of which draws for several subsets with as many bits; the sparsest level that a fingerprint
#: may begin with leaves bits for the levels after it.
HASHES, DRAWS, DRAW_BITS, DEEPEST = 5, 3, 21, 19
#: Subsets of a level, and levels that a fingerprint has.
SUBSETS, LEVELS = HASHES * DRAWS, 3
#: What xxhash64 makes of an empty array: its seed.
NOTHING = 42


def term_hashes(text: Column) -> Column:
    """Hashes of the distinct words of a text: runs of letters and digits, in lower case."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.array_distinct(F.transform(words, lambda w: F.xxhash64(w)))


def lexicon(docs: DataFrame, work: Workspace, *, text_col: str = "text", low: float = LOW, high: float = HIGH) -> DataFrame:
    """One row of a size that doesn't depend on the number of documents: ``bits``, the bitmap as 64-bit words, ``first``, where
    each word's bucket begins, and ``hashes``, those of the lexicon's terms by bucket.

    Terms of LEAST documents are in it however high their share is, which tells below LEAST / high documents only. Raises
    ValueError if there are more than MOST terms; a larger ``low`` leaves fewer."""
    n = docs.count()
    terms = docs.select(F.explode(term_hashes(F.coalesce(F.col(text_col), F.lit("")))).alias("h"))
    band = terms.groupBy("h").agg(F.count(F.lit(1)).alias("df")).where((F.col("df") >= max(LEAST, low * n)) & (F.col("df") <= max(LEAST, high * n)))
    hashes = np.sort(band.select("h").limit(MOST + 1).toArrow()["h"].to_numpy())
    if len(hashes) > MOST:
        raise ValueError(f"the band holds more than {MOST} terms; raise low above {low}")
    slot = hashes & ((1 << SLOTS) - 1)
    hashes, slot = (x[np.argsort(slot, kind="stable")] for x in (hashes, slot))
    bits = np.zeros(1 << (SLOTS - 6), dtype=np.uint64)
    np.bitwise_or.at(bits, slot >> 6, np.uint64(1) << (slot & 63).astype(np.uint64))
    first = np.searchsorted(slot >> 6, np.arange(len(bits) + 1))
    parts = {"bits": bits.view(np.int64), "first": first, "hashes": hashes}
    row = pa.table({k: pa.array([x], pa.list_(pa.int64())) for k, x in parts.items()})
    return work.save(docs.sparkSession.createDataFrame(row), "lexicon")


def fingerprint(df: DataFrame, text: Column, lexicon: DataFrame, name: str) -> DataFrame:
    """Adds a fingerprint column: level, hash of all terms, and LEVELS x SUBSETS hashes of 16 bits, joined by dots."""
    word = lambda t: F.shiftright(t.bitwiseAND(F.lit((1 << SLOTS) - 1)), 6).cast("int") + 1
    marked = lambda x, t: F.call_function("getbit", F.element_at(x["bits"], word(t)), t.bitwiseAND(F.lit(63)).cast("int")) == 1
    start = lambda x, t, k: F.element_at(x["first"], word(t) + k).cast("int")
    bucket = lambda x, t: F.slice(x["hashes"], start(x, t, 0) + 1, start(x, t, 1) - start(x, t, 0))
    known = lambda x, t: marked(x, t) & F.array_contains(bucket(x, t), t)
    # The subquery can't stand in a lambda, but a column that is used once moves into the expression that uses it: there the
    # lexicon is handed on by reference, and no row has it as a column.
    df = df.withColumn("_lexicon", lexicon.select(F.struct("bits", "first", "hashes")).scalar())
    pair = F.struct(F.col("_lexicon").alias("lexicon"), term_hashes(text).alias("all"))
    told = lambda p: F.struct(p["all"].alias("all"), F.filter(p["all"], lambda t: known(p["lexicon"], t)).alias("terms"))
    df = df.withColumn("_told", F.transform(F.array(pair), told)[0]).drop("_lexicon")
    df = df.withColumn("_terms", F.sort_array("_told.terms"))
    whole = F.xxhash64(F.when(F.size("_terms") > 0, F.col("_terms")).otherwise(F.sort_array("_told.all")))
    df = df.withColumn("_whole", F.lpad(F.lower(F.hex(whole)), 16, "0")).drop("_told")
    df = df.withColumn("_level", F.least(F.floor(F.log2(F.greatest(F.size("_terms"), F.lit(1)))), F.lit(DEEPEST)).cast("int"))
    # A subset of a level has the terms whose hash has, in the bits of its draw, as many zeros at the end. What is in any
    # subset of the first level is kept as a column, so that the rest is worked out on a few terms only.
    # The bit above a draw's bits is lent when all of them are zero, which one subtraction tells for all draws (a loan to
    # the draw before lets a few more through).
    low = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_level")) - 1
    mask = reduce(lambda m, b: m.bitwiseOR(F.call_function("shiftleft", low, F.lit(b * DRAW_BITS))), range(DRAWS), F.lit(0).cast("long"))
    ones, lent = (F.lit(sum(1 << b * DRAW_BITS + k for b in range(DRAWS))) for k in (0, DRAW_BITS - 1))
    hashed = lambda j: F.transform("_terms", lambda t: F.xxhash64(t, F.lit(j)))
    drawn = lambda j: F.filter(hashed(j), lambda t: (t.bitwiseAND(F.col("_mask")) - ones).bitwiseAND(lent) != 0)
    df = df.withColumn("_mask", mask).withColumns({f"_drawn{j}": drawn(j) for j in range(HASHES)})
    further = lambda i, b: F.call_function("shiftleft", F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_level") + i) - 1, F.lit(b * DRAW_BITS))
    held = lambda j, b, i: F.filter(f"_drawn{j}", lambda t: t.bitwiseAND(further(i, b)) == 0)
    hashes = F.array(*[F.xxhash64(held(j, b, i)) for i in range(LEVELS) for j in range(HASHES) for b in range(DRAWS)])
    parts = F.transform(hashes, lambda h: F.when(h == NOTHING, F.lit("-")).otherwise(F.lpad(F.lower(F.hex(h.bitwiseAND(F.lit(0xFFFF)))), 4, "0")))
    df = df.withColumn(name, F.concat_ws(".", F.col("_level").cast("string"), F.col("_whole"), F.array_join(parts, ".")))
    return df.drop("_terms", "_whole", "_level", "_mask", *[f"_drawn{j}" for j in range(HASHES)])


def likeness(a: Column, b: Column) -> Column:
    """Share of the subsets of common levels that agree, among those with terms in either; 1 for equal fingerprints."""
    x, y = F.split(a, r"\."), F.split(b, r"\.")
    la, lb = (F.element_at(z, 1).cast("int") for z in (x, y))
    low, high = F.greatest(la, lb), F.least(la, lb) + LEVELS
    n = F.greatest((high - low) * SUBSETS, F.lit(0))
    part = lambda z, l: F.slice(z, 3 + (low - l) * SUBSETS, n)  # noqa: E731,E741
    pairs = F.arrays_zip(part(x, la).alias("p"), part(y, lb).alias("q"))
    told = F.filter(pairs, lambda z: (z["p"] != "-") | (z["q"] != "-"))
    same = F.filter(told, lambda z: z["p"] == z["q"])
    return F.when(a == b, F.lit(1.0)).when((n > 0) & (F.size(told) > 0), F.size(same) / F.size(told)).otherwise(F.lit(0.0)).cast("double")


def neighbours(rows: DataFrame, work: Workspace) -> DataFrame:
    """``row``, ``next_row`` of distinct rows (row, id): the next in descending order of ids, and the first after the last.

    Only ids are sorted. Each task of the sort finds the neighbours of its range; what is next to a range is found
    from one row for each range.
    """
    order = [F.desc_nulls_last("id"), F.desc("row")]
    ranged = rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id())
    ranged = work.save(ranged, "ranged")
    within = Window.partitionBy("part").orderBy(*order)
    near = ranged.withColumn("next_row", F.lead("row").over(within)).withColumn("place", F.row_number().over(within))
    first = near.where("place = 1").select("part", F.col("row").alias("first_row"))
    over = Window.orderBy("part")
    following = first.select("part", F.coalesce(F.lead("first_row").over(over), F.first("first_row").over(over)).alias("following"))
    return near.join(following, "part").select("row", F.coalesce("next_row", "following").alias("next_row"))


def edited_fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", low: float = LOW, high: float = HIGH) -> DataFrame:
    """The id, ``n_chars``, ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``, ``near_edited`` and ``near_next`` of each row.

    The edited text has the last floor(n/3) code points replaced by the first as many of the next document's text, in
    descending order of ids; after the last comes the first. Null counts as empty. Rows that repeat an id follow each
    other in the order of hashes of their texts; rows that repeat id and text are one document and give equal rows. Null
    ids come last. A document alone is next to itself. A text without lexicon terms has level 0 and no subset's hash, and
    is like equal fingerprints only. Other columns are not read; an empty table gives no rows.
    """
    work = Workspace(docs.sparkSession, "imatch")
    terms = lexicon(docs, work, text_col=text_col, low=low, high=high)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # A row is known by 128 bits of its id and text, the same whenever and wherever it is read.
    rows = rows.withColumn("row", F.struct(F.xxhash64("id", "text").alias("a"), F.xxhash64("text", F.lit(1), "id").alias("b")))
    rows = rows.withColumn("n", F.length("text").cast("long"))
    prints = work.save(fingerprint(rows, F.col("text"), terms, "fingerprint").select("row", "id", "n", "fingerprint"), "fingerprints")
    following = work.save(neighbours(prints.select("row", "id").distinct(), work), "following")
    single = prints.dropDuplicates(["row"])
    cuts = single.select("row", F.floor(F.col("n") / 3).cast("int").alias("cut")).join(following, "row")
    cuts = work.save(cuts.select(F.col("row").alias("from"), F.col("next_row").alias("row"), "cut"), "cuts")
    texts = rows.select("row", "text")  # both joins below read one shuffle of it
    heads = texts.join(cuts.hint("merge"), "row").select(F.col("from").alias("row"), F.expr("substring(text, 1, cut)").alias("head"))
    edited = texts.join(heads.groupBy("row").agg(F.min("head").alias("head")).hint("merge"), "row")
    edited = edited.select("row", F.concat(F.expr("substring(text, 1, CAST(length(text) - floor(length(text) / 3) AS INT))"), "head").alias("edited"))
    edited = edited.withColumn("edited_sha256", F.sha2("edited", 256))
    edited = work.save(fingerprint(edited, F.col("edited"), terms, "edited_fingerprint").drop("edited"), "edited")
    out = prints.join(edited.dropDuplicates(["row"]), "row")
    next_ = single.select(F.col("row").alias("next_row"), F.col("fingerprint").alias("next_fingerprint"))
    near = out.join(following, "row").join(next_, "next_row")
    near = near.withColumn("near_edited", likeness(F.col("fingerprint"), F.col("edited_fingerprint"))).withColumn("near_next", likeness(F.col("fingerprint"), F.col("next_fingerprint")))
    return work.finish(near.select(F.col("id").alias(id_col), F.col("n").alias("n_chars"), "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"))
