"""Toxicity scores: misspelt lexicon terms by Levenshtein automata, weighed by their context.

1. A lexicon is learnt from a bounded sample of labelled rows: words whose rate of toxic texts is so high that chance
   would not bring it about for any of the words tried (a likelihood ratio against the sample's rate, held against the
   number of words). Near copies in the sample are one class, and a class has one vote for each label it bears, so copies
   don't multiply a word. Words of untoxic sample texts that resemble a term are noted as no misspellings.
2. Every word of every text runs through the automata of the terms intersected with their trie.
3. A window around each hit tells quotation (quotation marks around it, words of reporting) from abuse (words that
   address someone). A logistic model over exact, misspelt and quoted hits, fitted on the same sample, gives the score.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import labelled, text
from .levenshtein import Automaton
from .near_dedup import near_duplicates
from .shared import ship

#: The bound of the sample of labelled rows.
AT_MOST = 40_000
#: Sample texts alike in this share of their shingles are near copies, edited ones too, and have one vote together.
COPY_SHINGLE, COPY_NUM, COPY_DEN = 3, 1, 2
#: Words on either side of a hit that make its window, and the bytes on either side searched for quotation marks: marks
#: farther away don't quote a word, as they rarely belong to it. ``train`` takes another number.
WINDOW, MARKS = 8, 80
#: Words whose verdict a worker remembers.
REMEMBERED = 400_000
#: Words of reporting and of addressing someone, in four languages; ``train`` takes others.
REPORTING = frozenset("said says say called calls quote quoted wrote writes word term dit écrit mot sagte sagt schrieb wort dijo dice escribió palabra".split())
ADDRESSING = frozenset("you your youre u du dich dein dir ihr tu te toi ton vous votre tú ti usted ustedes vosotros".split())
#: A word as the readers take it: runs of ASCII letters and digits and of characters beyond ASCII that aren't punctuation.
_WORD = r"[a-z0-9\u00aa\u00b5\u00ba\u00c0-\u1fff\u2070-\u2fff\u3040-\x{10FFFF}]+"
_OPEN = [x.encode() for x in ("“", "„", "«", "‹")]
_CLOSE = [x.encode() for x in ("”", "“", "»", "›")]
FEATURES = 7


@dataclass
class Lexicon:
    """terms with their weights; ``spared``: words that resemble a term and are none."""

    terms: list[str] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    spared: frozenset[str] = frozenset()
    reporting: frozenset[str] = REPORTING
    addressing: frozenset[str] = ADDRESSING
    marks: int = MARKS
    intercept: float = -2.0
    coefficients: list[float] = field(default_factory=lambda: [0.0] * FEATURES)


class Reader:
    """Finds hits in slices of lower-cased texts."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon, self.automaton = lexicon, Automaton(lexicon.terms)
        self.weight = dict(zip(lexicon.terms, lexicon.weights, strict=True))
        self.known: dict[int, tuple[int, int] | None] = {}
        #: No spelling of a term has more bytes: two characters more than the longest term, of four bytes each.
        self.most = 4 * (max(map(len, lexicon.terms), default=0) + 2)

    def match(self, word: str) -> tuple[int, int] | None:
        found = self.automaton.match(word)
        return None if found and found[0] and word in self.lexicon.spared else found

    def features(self, texts: text.Texts) -> np.ndarray:
        """Per text: strongest exact hit, exact hits, strongest misspelt hit, misspelt hits, quoted hits, addressed hits, hits a word."""
        out = np.zeros((len(texts), FEATURES))
        w = text.words(texts, text.ALNUM, ascii_lower=False)
        if not len(w.hash) or not self.lexicon.terms:
            return out
        hashes, at, back = np.unique(w.hash, return_index=True, return_inverse=True)
        hit = np.zeros(len(hashes), dtype=bool)
        known, data, verdicts = self.known, texts.data, {}
        if len(known) + len(hashes) > REMEMBERED:
            known.clear()
        raw = data.tobytes()
        for i, h in enumerate(hashes.tolist()):
            if h in known:
                verdict = known[h]
            else:
                word = raw[w.start[at[i]] : w.end[at[i]]]
                verdict = known[h] = self.match(word.decode("utf-8", "replace")) if len(word) <= self.most else None
            if verdict:
                hit[i], verdicts[i] = True, verdict
        places = np.flatnonzero(hit[back])
        by_text: dict[int, list[tuple[float, int, bool, bool]]] = {}
        for p in places.tolist():
            edits, term = verdicts[int(back[p])]
            doc = int(w.doc[p])
            quoted, addressed = self._context(raw, texts, w, p, doc)
            by_text.setdefault(doc, []).append((self.lexicon.weights[term], edits, quoted, addressed))
        for doc, hits in by_text.items():
            exact = [x for x, e, q, _ in hits if not e and not q]
            near = [x / (1 + e) for x, e, q, _ in hits if e and not q]
            out[doc] = (max(exact, default=0) / 5, math.log1p(len(exact)), max(near, default=0) / 5, math.log1p(len(near)), math.log1p(sum(q for *_, q, _ in hits)), math.log1p(sum(a and not q for *_, q, a in hits)), 10 * len(hits) / (w.first[doc + 1] - w.first[doc]))
        return out

    def _context(self, raw: bytes, texts: text.Texts, w: text.Words, p: int, doc: int) -> tuple[bool, bool]:
        a, b = max(w.first[doc], p - WINDOW), min(w.first[doc + 1], p + WINDOW + 1)
        around = {raw[w.start[i] : w.end[i]].decode("utf-8", "replace") for i in range(a, b) if i != p}
        left = raw[max(texts.offsets[doc], w.start[p] - self.lexicon.marks) : w.start[p]]
        right = raw[w.end[p] : min(texts.offsets[doc + 1], w.end[p] + self.lexicon.marks)]
        marked = (left.count(b'"') % 2 == 1 and b'"' in right) or any(left.rfind(o) > left.rfind(c) and c in right for o, c in zip(_OPEN, _CLOSE, strict=True))
        addressed = bool(around & self.lexicon.addressing)
        return marked or (bool(around & self.lexicon.reporting) and not addressed), addressed

    def score(self, texts: text.Texts) -> np.ndarray:
        y = self.lexicon.intercept + self.features(texts) @ np.asarray(self.lexicon.coefficients)
        return 1 / (1 + np.exp(-np.clip(y, -30, 30)))


def lowered(column: pa.Array) -> pa.Array:
    return pc.utf8_lower(column.cast(pa.large_string()).fill_null(""))


def choose_terms(counts: pa.Table, toxic: int, clean: int) -> tuple[list[str], list[float]]:
    """The words far more toxic than chance allows, and their weights, from counts of classes of near copies by word."""
    if not toxic or not clean or not counts.num_rows:
        return [], []
    n1, n0 = (counts[c].to_numpy().astype(float) for c in ("n1", "n0"))
    base, n = toxic / (toxic + clean), n1 + n0
    gain = n1 * np.log(n1 / n / base) + np.where(n0 > 0, n0 * np.log(np.maximum(n0, 1) / n / (1 - base)), 0)
    chosen = (n1 / n >= max(0.6, 2 * base)) & (gain >= math.log(max(counts["tried"][0].as_py(), 2)))
    words, weights = counts["word"].to_pylist(), np.log((n1 + 0.5) / (n0 + 0.5)) - math.log(base / (1 - base))
    picked = sorted((words[i], float(weights[i])) for i in np.flatnonzero(chosen))
    return [w for w, _ in picked], [x for _, x in picked]


def _votes(drawn: DataFrame) -> tuple[DataFrame, tuple[int, int]]:
    """``word``, ``n1``, ``n0``: classes of near copies that have the word in a toxic text, in a clean one; and how many
    classes have a toxic text, a clean one. Texts without words are classes of their own."""
    found = F.regexp_extract_all(F.lower("text"), F.lit(_WORD), F.lit(0))
    groups = near_duplicates(drawn, id_col="row", shingle=COPY_SHINGLE, num=COPY_NUM, den=COPY_DEN).select(F.col("row"), F.col("component_id").alias("class"))
    rows = drawn.join(groups, "row")
    totals = rows.select("label", "class").distinct().agg(F.count_if(F.col("label") == 1), F.count_if(F.col("label") == 0)).first()
    words = rows.select("label", "class", F.explode(F.array_distinct(found)).alias("word"))
    by_class = words.groupBy("word", "class").agg(F.max("label").alias("any1"), F.max(1 - F.col("label")).alias("any0"))
    votes = by_class.groupBy("word").agg(F.sum("any1").cast("long").alias("n1"), F.sum("any0").cast("long").alias("n0"))
    return votes.persist(), tuple(totals)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, list[float]]:
    """Newton's method with a small ridge."""
    x1 = np.concatenate([np.ones((len(x), 1)), x], axis=1)
    beta = np.zeros(x1.shape[1])
    share = min(max(y.mean(), 1e-3), 1 - 1e-3) if len(y) else 0.1
    beta[0] = math.log(share / (1 - share))
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x1 @ beta, -30, 30)))
        penalty = ridge * np.r_[1e-6, np.ones(len(beta) - 1)] * max(1.0, len(y) ** 0.5)
        step = np.linalg.solve((x1 * (p * (1 - p))[:, None]).T @ x1 + np.diag(penalty + 1e-9), x1.T @ (y - p) - penalty * beta)
        size = np.abs(step).max()
        beta += step * min(1.0, 4 / max(size, 1e-12))
        if size < 1e-7:
            break
    return float(beta[0]), beta[1:].tolist()


def train(docs: DataFrame, labels: DataFrame, *, modulus: int = 4, held_out: int = 2, at_most: int = AT_MOST, id_col: str = "doc_id", text_col: str = "text", reporting: frozenset[str] = REPORTING, addressing: frozenset[str] = ADDRESSING, marks: int = MARKS) -> Lexicon:
    """Learns a lexicon and the weights of hits on about ``at_most`` labelled rows at most, without held-out ones."""
    spark = docs.sparkSession
    ship(spark)
    drawn = labelled.with_texts(labelled.sample(labels, "toxic", modulus=modulus, held_out=held_out, at_most=at_most, id_col=id_col), docs, id_col=id_col, text_col=text_col)
    drawn = drawn.withColumn("row", F.xxhash64("text")).persist()
    votes, classes = _votes(drawn)
    tried = votes.where("n1 + n0 >= 3").count()
    table = votes.where("n1 >= 3 AND n1 > n0").withColumn("tried", F.lit(tried).cast("long")).toArrow()
    lexicon = Lexicon(*choose_terms(table, *classes), reporting=reporting, addressing=addressing, marks=marks)
    if lexicon.terms:
        shared = spark.sparkContext.broadcast(lexicon)  # bounded by the sample

        def resembling(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            reader = Reader(shared.value)
            for batch in batches:
                keep = [bool((m := reader.match(x)) and m[0]) for x in batch.column(0).to_pylist()]
                yield batch.filter(pa.array(keep, pa.bool_()))

        near = votes.where("n0 >= 1").select("word").mapInArrow(resembling, "word string").toArrow()
        lexicon.spared = frozenset(near["word"].to_pylist())
        shared = spark.sparkContext.broadcast(lexicon)

        def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            reader = Reader(shared.value)
            for batch in text.small(batches):
                for at, part in text.slices(lowered(batch.column(0))):
                    x = reader.features(part)
                    flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * FEATURES), pa.array(x.ravel()))
                    yield pa.RecordBatch.from_arrays([batch.column(1).slice(at, len(x)), flat], names=["label", "x"])

        rows = drawn.select("text", "label").mapInArrow(measured, "label int, x array<double>").toArrow()
        x = np.array(rows["x"].to_pylist())
        y = rows["label"].to_numpy().astype(float)
        order = np.lexsort((*x.T, y))
        lexicon.intercept, lexicon.coefficients = logistic(x[order], y[order])
    elif sum(totals := drawn.agg(F.count_if(F.col("label") == 1), F.count_if(F.col("label") == 0)).first()):
        share = min(max(totals[0] / sum(totals), 0.01), 0.99)
        lexicon.intercept = math.log(share / (1 - share))
    votes.unpersist()
    drawn.unpersist()
    return lexicon


_readers: list[tuple[Lexicon, Reader]] = []


def reader_of(lexicon: Lexicon) -> Reader:
    """The worker's reader for a lexicon, kept while the lexicon is the same."""
    if not _readers or _readers[0][0] != lexicon:
        _readers[:] = [(lexicon, Reader(lexicon))]
    return _readers[0][1]


def score(docs: DataFrame, lexicon: Lexicon, *, modulus: int = 4, held_out: int = 2, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ``held_out``, ``score`` (0 to 1) and ``predicted`` (1 from the threshold on) of each row.

    Null and empty texts have no hit and get the score of such texts. Repeated rows each give a row; other columns are
    not read; an empty table gives no rows. A null id counts as the empty text for ``held_out``.
    """
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = reader_of(shared.value)
        for batch in text.small(batches):
            for at, part in text.slices(lowered(batch.column(2))):
                yield pa.RecordBatch.from_arrays([*(c.slice(at, len(part)) for c in batch.columns[:2]), pa.array(reader.score(part))], names=["id", "held_out", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), (labelled.remainder(id_col, modulus) == held_out).alias("held_out"), F.col(text_col).alias("text"))
    scored = rows.mapInArrow(run, f"id {kind}, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int")).withColumnRenamed("id", id_col)


def keep_clean(docs: DataFrame, lexicon: Lexicon, *, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows, all columns as they are, whose score is below the threshold."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(lexicon)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = reader_of(shared.value)
        for batch in text.small(batches):
            kept = [reader.score(part) < threshold for _, part in text.slices(lowered(batch.column(at)))]
            yield batch.filter(pa.array(np.concatenate(kept))) if kept else batch

    return docs.mapInArrow(run, docs.schema)
