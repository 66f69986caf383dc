"""How filters work together, by signed parity sums.

A document's failures are a mask of one bit for each filter. For each subset s of the filters a part's documents are
summed with the sign +1 where they fail an even number of the filters in s and -1 otherwise: the Walsh-Hadamard transform
of the counts of masks. These sums add up over tasks in any order and are of a fixed number, whatever a part's size; the
same transform divided by the number of masks gives the counts of masks back, exactly. Counts of masks answer all orders
of the filters: a document with mask m is left after the filters S if m has none of S, and is removed by the first filter
of the order that is in m. Over all orders each of its k failing filters removes it equally often, which gives the Shapley
value in closed form: orders / k.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The five filters, in the order of the bits of a mask. E asks other documents.
FILTERS = "ABCDE"
_WORD = r"[^\x20\x09-\x0D]+"
#: The documents that are counted: all, those labelled good, those labelled toxic.
_LABELS = ("all", "good", "toxic")


def _bit(letter: str) -> int:
    return 1 << FILTERS.index(letter)


def text_mask(text: Column) -> Column:
    """The failures that a text tells by itself, as bits of A to D.

    A: under 200 words; B: fewer distinct words than half of the words; C: more than 2 % capitals A-Z; D: one of #$%&*|.
    """
    words = F.regexp_extract_all(text, F.lit(_WORD), F.lit(0))
    fails = {
        "A": lambda n, d: n < 200,
        "B": lambda n, d: d * 100 < n * 50,
        "C": lambda n, d: F.regexp_count(text, F.lit("[A-Z]")) * 100 > F.length(text) * 2,
        "D": lambda n, d: text.rlike(r"[#$%&*|]"),
    }
    # The words are taken once: what both tests ask of them is a struct that a transform of one element names.
    counted = F.transform(F.array(words), lambda w: F.struct(F.size(w).cast("long").alias("n"), F.size(F.array_distinct(w)).cast("long").alias("d")))
    return F.transform(counted, lambda c: sum((F.when(fail(c["n"], c["d"]), _bit(x)).otherwise(0) for x, fail in fails.items()), F.lit(0)))[0]


def masks(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """``part``, ``mask``, ``good``, ``toxic`` and ``n``: how many documents there are of each.

    Equal texts fail alike but for E, which the least id among them passes. Rows that are equal in id, text and part are
    counted before anything is joined, so no key has more rows than a text has ids, or an id parts and masks.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.sha2(text, 256).alias("digest"), text_mask(text).alias("mask"))
    rows = rows.groupBy("digest", "id", "part", "mask").agg(F.count(F.lit(1)).alias("n"))
    first = rows.groupBy("digest").agg(F.min("id").alias("id")).where("id IS NOT NULL").withColumn("first", F.lit(True))
    late = F.col("id").isNotNull() & F.col("first").isNull()
    told = rows.join(first, ["digest", "id"], "left").withColumn("mask", F.col("mask") + F.when(late, _bit("E")).otherwise(0))
    told = told.groupBy("id", "part", "mask").agg(F.sum("n").alias("n"))
    has = lambda c: F.coalesce(F.max(F.col(c).cast("int")) == 1, F.lit(False)).alias(c)
    marks = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(has("quality"), has("toxic"))
    said = told.join(marks, "id", "left").withColumns({"good": F.coalesce("quality", F.lit(False)), "toxic": F.coalesce("toxic", F.lit(False))})
    return said.groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))


def _sign(s: Column, mask: Column) -> Column:
    return 1 - 2 * (F.bit_count(s.bitwiseAND(mask)) % 2)


def parity_sums(counted: DataFrame, n_masks: int = 1 << len(FILTERS)) -> DataFrame:
    """``part``, ``label`` and ``sums``, the signed sum of each subset of filters; a part has a row for each label."""
    which = F.filter(F.array(F.lit("all"), F.when(F.col("good"), F.lit("good")), F.when(F.col("toxic"), F.lit("toxic"))), lambda x: x.isNotNull())
    signed = [F.sum(F.col("n") * _sign(F.lit(s), F.col("mask"))).alias(f"_{s}") for s in range(n_masks)]
    return counted.withColumn("label", F.explode(which)).groupBy("part", "label").agg(*signed).select("part", "label", F.array(*[F.col(f"_{s}") for s in range(n_masks)]).alias("sums"))


def cells(sums: DataFrame, n_masks: int = 1 << len(FILTERS)) -> DataFrame:
    """``part`` and the counts of masks for each label, back from the signed sums; a label that a part lacks has zeros."""
    subsets = F.sequence(F.lit(0), F.lit(n_masks - 1))
    inverse = F.transform(subsets, lambda m: F.aggregate(F.zip_with("sums", subsets, lambda w, s: w * _sign(s, m)), F.lit(0).cast("long"), lambda a, x: a + x, lambda a: (a / n_masks).cast("long")))
    counts = sums.select("part", "label", inverse.alias("counts"))
    zeros = F.array_repeat(F.lit(0).cast("long"), n_masks)
    return counts.groupBy("part").agg(*[F.coalesce(F.max(F.when(F.col("label") == x, F.col("counts"))), zeros).alias(x) for x in _LABELS])


def orders(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """A row for each part, order of the filters and step, with what the step's filter does there."""
    n = len(filters)
    every = F.split(F.lit(" ".join(map("".join, itertools.permutations(filters)))), " ")
    bit_at = lambda k: F.call_function("shiftleft", F.lit(1), F.call_function("locate", F.substring("filter_order", k, F.lit(1)), F.lit(filters)) - 1)
    places = F.sequence(F.lit(1), F.lit(n))
    rows = counts.withColumn("filter_order", F.explode(every)).withColumn("step", F.explode(places))
    earlier = F.aggregate(places, F.lit(0), lambda a, k: a + F.when(k < F.col("step"), bit_at(k)).otherwise(0))
    rows = rows.withColumns({"before": earlier, "bit": bit_at(F.col("step"))})
    subsets = F.sequence(F.lit(0), F.lit((1 << n) - 1))
    before, bit = F.col("before"), F.col("bit")

    def total(label: str, weight) -> Column:
        return F.aggregate(F.zip_with(label, subsets, lambda c, m: c * weight(m)), F.lit(0).cast("long"), lambda a, x: a + x)

    one = lambda test: F.when(test, 1).otherwise(0)
    has = lambda m, s: m.bitwiseAND(s) != 0
    removed = lambda m: one(has(m, bit) & ~has(m, before))
    often = math.factorial(n)
    shapley = lambda m: F.when(has(m, bit), F.floor(F.lit(often) / F.bit_count(m)).cast("long")).otherwise(0)
    return rows.select(
        "part",
        "filter_order",
        "step",
        total("all", lambda m: one(~has(m, before.bitwiseOR(bit)))).alias("kept"),
        total("all", removed).alias("removed"),
        total("all", lambda m: one(has(m, bit) & has(m, before))).alias("redundant"),
        total("all", lambda m: one(m == bit)).alias("unique_fails"),
        total("good", removed).alias("good_lost"),
        total("toxic", removed).alias("toxic_lost"),
        total("all", shapley).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """For each part, each of the 120 orders of the five filters and each step: documents ``kept`` after it, ``removed``
    here, ``redundant`` (fail its filter but were removed before), ``unique_fails`` (fail its filter only), ``good_lost``
    and ``toxic_lost`` (removed here and so labelled), and ``shapley`` (removed by its filter over all orders).

    A null text counts as empty and a null part as the part of the empty string. Repeated rows count as often as they are
    there; rows of the least id of a text pass E, however many. A document without an id neither fails E nor makes others
    fail, and has no labels. Of labels that repeat an id any that says so counts. Other columns are not read; an empty
    table gives no rows.
    """
    return orders(cells(parity_sums(masks(docs, labels, id_col=id_col, text_col=text_col, part_col=part_col))))


#: The same rows by counting each order on its own.
ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS least FROM d),
f AS (SELECT w.doc_id, part, coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS toxic,
        [len(words) < 200, 100 * len(list_distinct(words)) < 50 * len(words), 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text),
         regexp_matches(text, '[#$%&*|]'), w.doc_id > least] AS fails FROM w LEFT JOIN labels USING (doc_id)),
c AS (SELECT part, fails, len(list_filter(fails, lambda x: x)) AS k, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY 1, 2),
l AS (SELECT unnest(range(1, 6)) AS i),
p AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
s AS (SELECT list_reduce(list_transform(o, lambda x: 'ABCDE'[x]), lambda a, b: a || b) AS filter_order, l.i AS step, o[l.i] AS here, o[1:l.i - 1] AS before FROM p, l),
t AS (SELECT part, filter_order, step, n, good, toxic, k, fails[here] AS bad, len(list_filter(before, lambda x: fails[x])) > 0 AS gone FROM c, s)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(coalesce(sum(n) FILTER (NOT bad AND NOT gone), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (bad AND NOT gone), 0) AS BIGINT) AS removed,
       CAST(coalesce(sum(n) FILTER (bad AND gone), 0) AS BIGINT) AS redundant, CAST(coalesce(sum(n) FILTER (bad AND k = 1), 0) AS BIGINT) AS unique_fails,
       CAST(coalesce(sum(good) FILTER (bad AND NOT gone), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(toxic) FILTER (bad AND NOT gone), 0) AS BIGINT) AS toxic_lost,
       CAST(coalesce(sum(n * 120 // greatest(k, 1)) FILTER (bad), 0) AS BIGINT) AS shapley
FROM t GROUP BY 1, 2, 3
"""
