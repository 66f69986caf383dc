"""Benchmark decontamination: passages of documents query a BM25 index of test items by block-max WAND.

Test items are cut into units of at most UNIT words. A unit's BM25 score of a passage is divided by its score of
itself, so one threshold, a share, fits units of any length. Every passage, PASSAGE words at steps of half as many,
is a query: a unit lies whole in one passage at least.

Before a passage is run through the index, upper bounds are summed for all passages of many documents at once: each
unit has a few heavy terms, beyond which its terms can add up to half of the threshold at most, so a passage that lacks
heavy terms worth the other half can't reach the threshold with any unit and is skipped without loss. The others go
through block-max WAND, which gives every unit above the threshold. The passages that an item's units are retrieved for
make regions: runs without a gap longer than a passage and what the question may lack. What is retrieved is verified on
words: the share of the question's 5-word shingles, and of the answer's words, that one region holds.

The index of a block of items is broadcast; its size is bounded, but that a block has one item at least. More items take
more passes over the documents: each pass is written before the next, and its index released. Document frequencies and
the mean length are those of the units of all items, so a unit's score doesn't depend on the blocks.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import text
from .shared import Workspace, ship
from .toxicity import lowered

UNIT, PASSAGE, SHINGLE = 64, 128, 5
THRESHOLD, QUESTION, ANSWER = 0.6, 0.8, 0.5
K1, B = 1.2, 0.75
POSTINGS = 16
#: UTF-8 bytes of items in one index.
BLOCK_BYTES = 8 << 20


def ngrams(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of runs of ``size`` words; of the whole sequence if it is shorter."""
    size = min(size, len(hashes))
    if not size:
        return hashes
    out = np.full(len(hashes) - size + 1, size, dtype=text.U)
    for k in range(size):
        out = text.mix(out * text.U(0x9FB21C651E98DF25) + hashes[k : len(hashes) - size + 1 + k])
    return out


def _word_hashes(texts: list[str]) -> list[np.ndarray]:
    out = []
    for _, part in text.slices(lowered(pa.array(texts, pa.string()))):
        w = text.words(part, text.ALNUM, ascii_lower=False)
        out += [w.hash[a:b] for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
    return out


def split_answer(item: str) -> tuple[str, str]:
    """Question and answer: an item's last sentence is its answer, if anything stands before it."""
    body = item.rstrip().rstrip(".!?…").rstrip()
    cut = max(body.rfind(x) for x in (". ", "? ", "! ", ".\n", "?\n", "!\n", "\n"))
    return (item, "") if cut <= 0 else (body[: cut + 1], body[cut + 1 :])


def units_of(hashes: np.ndarray) -> list[Counter]:
    return [Counter(hashes[at : at + UNIT].tolist()) for at in range(0, len(hashes), UNIT)]


class Statistics:
    """How many units there are, their words in all, and how many units have each of the words."""

    def __init__(self, units: list[Counter]):
        self.n, self.words = len(units), sum(sum(u.values()) for u in units)
        self.df = Counter(t for u in units for t in u)


class Index:
    """Inverted lists of units with block maxima. Items are (id, text), each id once or more.

    ``over``: the statistics of the units of all items, where these aren't all."""

    def __init__(self, items: list[tuple[int, str]], over: Statistics | None = None):
        whole = _word_hashes([t or "" for _, t in items])
        parts = [split_answer(t or "") for _, t in items]
        questions, answers = _word_hashes([q for q, _ in parts]), _word_hashes([a for _, a in parts])
        self.ids = [i for i, _ in items]
        self.question = [np.unique(ngrams(q, SHINGLE)) for q in questions]
        self.run = [min(SHINGLE, len(q)) for q in questions]
        self.gap = [PASSAGE + math.ceil((1 - QUESTION) * len(h)) for h in whole]
        self.answer = [np.unique(a) for a in answers]
        self.item: list[int] = []
        units: list[Counter] = []
        for k, h in enumerate(whole):
            own_units = units_of(h)
            self.item += [k] * len(own_units)
            units += own_units
        over = over or Statistics(units)
        n, df, mean = over.n, over.df, over.words / max(over.n, 1)
        lists: dict[int, list[tuple[int, float]]] = {}
        heavy: list[tuple[int, int, float]] = []
        for k, u in enumerate(units):
            size = sum(u.values())
            w = {t: math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * f * (K1 + 1) / (f + K1 * (1 - B + B * size / mean)) for t, f in u.items()}
            own, rest = sum(w.values()), 1.0
            for t, x in sorted(w.items(), key=lambda p: (-p[1], p[0])):
                lists.setdefault(t, []).append((k, x / own))
                if rest > THRESHOLD / 2:
                    heavy.append((t, k, x / own))
                    rest -= x / own
        self.lists = {t: (np.array([k for k, _ in p]), np.array([x for _, x in p])) for t, p in lists.items()}
        self.block_max = {t: np.maximum.reduceat(x, np.arange(0, len(x), POSTINGS)) for t, (_, x) in self.lists.items()}
        self.max = {t: float(x.max()) for t, (_, x) in self.lists.items()}
        heavy.sort()
        self.heavy_terms = np.unique(np.array([t for t, _, _ in heavy], dtype=text.U))
        self.heavy_first = np.searchsorted(np.array([t for t, _, _ in heavy], dtype=text.U), self.heavy_terms)
        self.heavy_first = np.append(self.heavy_first, len(heavy))
        self.heavy_unit = np.array([k for _, k, _ in heavy], dtype=np.int64)
        self.heavy_weight = np.array([x for _, _, x in heavy])

    def search(self, terms: list[int], threshold: float = THRESHOLD) -> list[tuple[int, float]]:
        """Units whose share of their own score reaches the threshold, by block-max WAND over the given distinct terms."""
        cursors = [[t, 0] for t in terms if t in self.lists]
        eps, found = 1e-9, []
        while cursors:
            cursors.sort(key=lambda c: self.lists[c[0]][0][c[1]])
            bound, pivot = 0.0, -1
            for i, (t, _) in enumerate(cursors):
                bound += self.max[t]
                if bound >= threshold - eps:
                    pivot = i
                    break
            if pivot < 0:
                break
            unit = int(self.lists[cursors[pivot][0]][0][cursors[pivot][1]])
            while pivot + 1 < len(cursors) and self.lists[cursors[pivot + 1][0]][0][cursors[pivot + 1][1]] == unit:
                pivot += 1
            # The blocks that would hold the pivot bound its score more tightly than whole lists do.
            near, until = 0.0, None
            for t, at in cursors[: pivot + 1]:
                ks = self.lists[t][0]
                to = at + int(np.searchsorted(ks[at:], unit))
                if to < len(ks):
                    near += self.block_max[t][to // POSTINGS]
                    last = (to // POSTINGS + 1) * POSTINGS - 1
                    ends = int(ks[min(last, len(ks) - 1)]) + 1
                    until = ends if until is None else min(until, ends)
            if near >= threshold - eps:
                score = 0.0
                for c in cursors[: pivot + 1]:
                    ks, xs = self.lists[c[0]]
                    c[1] += int(np.searchsorted(ks[c[1] :], unit))
                    if c[1] < len(ks) and ks[c[1]] == unit:
                        score += float(xs[c[1]])
                        c[1] += 1
                if score >= threshold - eps:
                    found.append((unit, score))
            else:
                target = until if until is not None else unit + 1
                if pivot + 1 < len(cursors):
                    target = min(target, int(self.lists[cursors[pivot + 1][0]][0][cursors[pivot + 1][1]]))
                target = max(target, unit + 1)
                for c in cursors[: pivot + 1]:
                    c[1] += int(np.searchsorted(self.lists[c[0]][0][c[1] :], target))
            cursors = [c for c in cursors if c[1] < len(self.lists[c[0]][0])]
        return found

    def matches(self, texts: text.Texts) -> list[tuple[int, int, float, float, float]]:
        """(text, item, score, question's share, answer's share) of what is retrieved and verified."""
        w = text.words(texts, text.ALNUM, ascii_lower=False)
        if not len(self.heavy_terms) or not len(w.hash):
            return []
        slot = np.minimum(np.searchsorted(self.heavy_terms, w.hash), len(self.heavy_terms) - 1)
        at = np.flatnonzero(self.heavy_terms[slot] == w.hash)
        counts = np.diff(self.heavy_first)[slot[at]]
        posting = np.repeat(self.heavy_first[slot[at]] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        word, unit, weight = np.repeat(at, counts), self.heavy_unit[posting], self.heavy_weight[posting]
        half = PASSAGE // 2
        step = (word - w.first[w.doc[word]]) // half  # a word is in the passage that starts at its step, and in the one before
        per = np.maximum(1, -(-np.diff(w.first) // half))
        base = np.concatenate([[0], np.cumsum(per)])
        first = base[w.doc[word]] + step
        both = np.concatenate([first, first[step > 0] - 1])
        key = both * len(self.item) + np.concatenate([unit, unit[step > 0]])
        keys, back = np.unique(key, return_inverse=True)
        worth = np.bincount(back, weights=np.concatenate([weight, weight[step > 0]]))
        hopeful = np.unique(keys[worth >= THRESHOLD / 2 - 1e-6] // len(self.item))
        places: dict[tuple[int, int], list[tuple[int, int, float]]] = {}
        for passage in hopeful.tolist():
            doc = int(np.searchsorted(base, passage, side="right")) - 1
            a = int(w.first[doc]) + (passage - int(base[doc])) * half
            b = min(a + PASSAGE, int(w.first[doc + 1]))
            for unit_, score in self.search(np.unique(w.hash[a:b]).tolist()):
                places.setdefault((doc, self.item[unit_]), []).append((a, b, score))
        out = []
        for (doc, item), found in sorted(places.items()):
            verified = [v for region in _regions(found, self.gap[item]) if (v := self._verified(w.hash, item, *region))]
            if verified:
                out.append((doc, item, *max(verified)))
        return out

    def _verified(self, words: np.ndarray, item: int, a: int, b: int, score: float) -> tuple[float, float, float] | None:
        """Score, question's share and answer's share of a region, if it holds enough of both."""
        asked, said, held = self.question[item], self.answer[item], words[a:b]
        question = float(np.isin(asked, ngrams(held, self.run[item])).mean()) if len(asked) else 1.0
        answer = float(np.isin(said, held).mean()) if len(said) else 1.0
        return (score, question, answer) if question >= QUESTION - 1e-9 and answer >= ANSWER - 1e-9 else None


def _regions(found: list[tuple[int, int, float]], gap: int) -> list[tuple[int, int, float]]:
    """Runs of passages (first word, end, score) with gaps of at most so many words, each with its best score."""
    out: list[tuple[int, int, float]] = []
    for a, b, score in sorted(found):
        if out and a - out[-1][1] <= gap:
            out[-1] = (out[-1][0], max(b, out[-1][1]), max(score, out[-1][2]))
        else:
            out.append((a, b, score))
    return out


def _blocks(benchmark: DataFrame, text_col: str, block_bytes: int | None) -> int:
    size = benchmark.agg(F.sum(F.octet_length(text_col).cast("long"))).first()[0] or 0
    return max(1, math.ceil(size / (block_bytes or BLOCK_BYTES)))


def indexes(benchmark: DataFrame, *, item_col: str = "item_id", text_col: str = "text", block_bytes: int | None = None) -> Iterator[Index]:
    """Indexes of blocks of items, each of about ``block_bytes`` of text (BLOCK_BYTES), each made when it is asked for."""
    rows = benchmark.select(F.col(item_col).alias("item"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    blocks = _blocks(benchmark, text_col, block_bytes)
    if blocks == 1:  # all items: their statistics are its own
        yield Index(_ordered(rows.distinct().toArrow().to_pylist()))
        return
    block = F.pmod(F.xxhash64(F.coalesce(F.col("item").cast("string"), F.lit("")), "text"), F.lit(blocks))
    frequencies = _frequencies(rows)
    for k in range(blocks):
        held = rows.where(block == k).distinct().toArrow().to_pylist()
        yield Index(_ordered(held), _statistics_of(frequencies, held))
    frequencies.unpersist()


def _ordered(held: list[dict]) -> list[tuple[int, str]]:
    return sorted(((x["item"], x["text"]) for x in held), key=lambda p: (p[0] is not None, p[0], p[1]))


def _frequencies(rows: DataFrame) -> DataFrame:
    """``term``, ``df`` over the units of all items; ``words`` of the units. A row with a null term counts the units."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = [u for h in _word_hashes(batch.column(0).to_pylist()) for u in units_of(h)]
            s = Statistics(units)
            terms = pa.array([*np.array(list(s.df), dtype=text.U).view(np.int64).tolist(), None], pa.int64())
            yield pa.RecordBatch.from_arrays([terms, pa.array([*s.df.values(), s.n], pa.int64()), pa.array([*[0] * len(s.df), s.words], pa.int64())], names=["term", "df", "words"])

    ship(rows.sparkSession)
    counted = rows.distinct().select("text").mapInArrow(count, "term long, df long, words long")
    return counted.groupBy("term").agg(F.sum("df").alias("df"), F.sum("words").alias("words")).persist()


def _statistics_of(frequencies: DataFrame, held: list[dict]) -> Statistics:
    """The statistics over all items, of the words of the items held: as many as the block has at most."""
    terms = np.unique(np.concatenate([np.zeros(0, text.U), *_word_hashes([x["text"] for x in held])])).astype(text.U)
    wanted = frequencies.sparkSession.createDataFrame(pa.table({"term": pa.array(terms.view(np.int64))}))
    found = frequencies.join(wanted, "term", "left_semi").select("term", "df").toArrow()
    total = frequencies.where("term IS NULL").first()
    out = Statistics([])
    out.n, out.words = (total["df"], total["words"]) if total else (0, 0)
    out.df = Counter(dict(zip(found["term"].to_numpy().astype(np.int64).view(text.U).tolist(), found["df"].to_pylist(), strict=True)))
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int | None = None) -> DataFrame:
    """A row for each document and test item it holds: ids, ``score``, ``question_overlap``, ``answer_overlap``.

    Words are runs of ASCII letters and digits and characters beyond ASCII, in lower case. Null and empty texts hold
    nothing and null or empty items are in nothing. Repeated document rows give repeated rows; repeated items count
    once. Other columns are not read; an empty table on either side gives no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    schema = f"id {kind}, item {item_kind}, score double, question_overlap double, answer_overlap double"
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    item_type = to_arrow_type(benchmark.schema[item_col].dataType)
    one = lambda index: rows.mapInArrow(_match(index, item_type), schema)
    return reduce(DataFrame.unionByName, _passes(spark, benchmark, one, item_col, item_text_col, block_bytes)).withColumnsRenamed({"id": id_col, "item": item_col})


def _passes(spark: SparkSession, benchmark: DataFrame, one: Callable[[Broadcast], DataFrame], item_col: str, text_col: str, block_bytes: int | None) -> Iterator[DataFrame]:
    """The result of ``one`` for each index. With several, each is written and its index released before the next is
    made; a single one is left to be run with what follows it."""
    several = _blocks(benchmark, text_col, block_bytes) > 1
    work = Workspace(spark, "passes")
    for index in indexes(benchmark, item_col=item_col, text_col=text_col, block_bytes=block_bytes):
        shared = spark.sparkContext.broadcast(index)
        del index
        done = one(shared)
        if several:
            done = work.save(done, "pass")
            shared.destroy()
        yield done


def _match(index: Broadcast, item_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text.small(batches):
            for at, part in text.slices(lowered(batch.column(1))):
                found = index.value.matches(part)
                ids = batch.column(0).slice(at, len(part)).take(pa.array([f[0] for f in found], pa.int64()))
                items = pa.array([index.value.ids[f[1]] for f in found], item_type)
                yield pa.RecordBatch.from_arrays([ids, items, *(pa.array([f[k] for f in found], pa.float64()) for k in (2, 3, 4))], names=["id", "item", "score", "question_overlap", "answer_overlap"])

    return run


def keep_uncontaminated(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int | None = None) -> DataFrame:
    """The rows, all columns as they are, that hold no test item."""
    spark = docs.sparkSession
    ship(spark)
    at = docs.columns.index(text_col)

    def keep(index):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in text.small(batches):
                clean = np.ones(batch.num_rows, dtype=bool)
                for first, part in text.slices(lowered(batch.column(at))):
                    clean[[first + f[0] for f in index.value.matches(part)]] = False
                yield batch.filter(pa.array(clean))

        return run

    kept = docs

    def one(index: Broadcast) -> DataFrame:
        return kept.mapInArrow(keep(index), docs.schema)

    for kept in _passes(spark, benchmark, one, item_col, item_text_col, block_bytes):  # noqa: B007
        pass  # each pass reads what the one before kept
    return kept
