"""Quality scores by a factorisation machine over hashed words, structure statistics and the length.

    y(x) = w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j

The pairwise part takes time linear in the features, as half of sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2). It is
fitted by logistic loss on a bounded sample of labelled rows; every text is scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import labelled, text
from .shared import ship

BUCKETS, RANK = 1024, 8
#: The bound of the sample that the model is fitted on, and the passes over it.
AT_MOST, EPOCHS = 8_000, 30

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in "!#$%&*|@^~<>{}[]\\=+_"]] = True
STATISTICS = ("upper", "symbol", "digit", "repeated", "distinct", "length of words", "no letters", "mixed", "words", "line length", "end marks", "most frequent")


def features(texts: text.Texts) -> tuple[np.ndarray, np.ndarray]:
    """How often each text has each hashed word (texts x BUCKETS), and its statistics."""
    n, data = len(texts), texts.data
    w = text.words(texts, text.NON_SPACE, ascii_lower=True)
    present = np.bincount(w.doc.astype(np.int64) * BUCKETS + (w.hash % text.U(BUCKETS)).astype(np.int64), minlength=n * BUCKETS).astype(np.float32).reshape(n, BUCKETS)
    ends = texts.offsets

    def count(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask)])
        return total[ends[1:]] - total[ends[:-1]]

    lower, upper = (data >= 97) & (data <= 122), (data >= 65) & (data <= 90)
    letters = count(lower | upper | (data >= 128))
    size = np.maximum(np.diff(ends), 1)
    number = np.diff(w.first)
    some = np.maximum(number, 1)
    again = np.bincount(w.doc[1:][(w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1])], minlength=n)
    distinct, most = np.zeros(n), np.zeros(n)
    ordered = w.hash.copy()
    for i, (a, b) in enumerate(zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True)):
        if a < b:
            part = ordered[a:b]
            part.sort()
            at = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]]))
            distinct[i], most[i] = len(at) - 1, np.diff(at).max()
    has_letter = np.concatenate([[0], np.cumsum(lower | upper | (data >= 128))])
    has_symbol = np.concatenate([[0], np.cumsum(_SYMBOL[data])])
    spelled, marked = has_letter[w.end] > has_letter[w.start], has_symbol[w.end] > has_symbol[w.start]
    stats = np.stack(
        [
            count(upper) / np.maximum(count(lower | upper), 1),
            count(_SYMBOL[data]) / size,
            count((data >= 48) & (data <= 57)) / size,
            again / some,
            distinct / some,
            letters / some / 10,
            np.bincount(w.doc[~spelled], minlength=n) / some,
            np.bincount(w.doc[spelled & marked], minlength=n) / some,
            np.log1p(number) / 8,
            np.log1p(size / (1 + count(data == 10))) / 8,
            count((data == 46) | (data == 33) | (data == 63)) / some,
            most / some,
        ],
        axis=1,
    )
    return present, stats.astype(np.float32)


@dataclass
class Machine:
    mean: np.ndarray
    scale: np.ndarray
    w0: float
    w: np.ndarray
    v: np.ndarray

    @staticmethod
    def matrix(present: np.ndarray, stats: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
        words = np.sqrt(present / np.maximum(present.sum(axis=1, keepdims=True), 1))  # of length 1, and never saturated
        z = (stats - mean) / scale
        return np.concatenate([words.astype(np.float32), np.clip(z, -4, 4), np.minimum(np.sqrt(np.abs(z)), 2) * np.sign(z), (z > 1).astype(np.float32)], axis=1).astype(np.float32)

    def score(self, present: np.ndarray, stats: np.ndarray) -> np.ndarray:
        x = self.matrix(present, stats, self.mean, self.scale)
        y = self.w0 + x @ self.w + 0.5 * ((x @ self.v) ** 2 - (x**2) @ (self.v**2)).sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(y, -30, 30)))


def fit(present: np.ndarray, stats: np.ndarray, label: np.ndarray, *, seed: int = 7) -> Machine:
    """Adam on the logistic loss; without examples of both kinds every score is the share of label 1 (1/2 without any)."""
    width = BUCKETS + 3 * len(STATISTICS)
    if len(label) == 0 or label.min() == label.max():
        share = float(label.mean()) if len(label) else 0.5
        share = min(max(share, 0.01), 0.99)
        return Machine(np.zeros(len(STATISTICS), np.float32), np.ones(len(STATISTICS), np.float32), float(np.log(share / (1 - share))), np.zeros(width, np.float32), np.zeros((width, RANK), np.float32))
    mean, scale = stats.mean(axis=0), stats.std(axis=0) + 1e-3
    x = Machine.matrix(present, stats, mean, scale)
    rng = np.random.default_rng(seed)
    share = label.mean()
    params = [np.array([np.log(share / (1 - share))], np.float32), np.zeros(width, np.float32), (rng.normal(size=(width, RANK)) * 0.02).astype(np.float32)]
    first, second, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    decay = [0, np.concatenate([np.full(BUCKETS, 1e-3), np.full(width - BUCKETS, 1e-5)]).astype(np.float32), np.concatenate([np.full(BUCKETS, 1e-3), np.full(width - BUCKETS, 1e-4)]).astype(np.float32)[:, None]]
    for epoch in range(EPOCHS):
        order, rate = rng.permutation(len(label)), 0.01 * (1 - epoch / EPOCHS) + 5e-4
        for i in range(0, len(order), 128):
            b = x[order[i : i + 128]]
            w0, w, v = params
            s = b @ v
            y = w0[0] + b @ w + 0.5 * (s**2 - (b**2) @ (v**2)).sum(axis=1)
            g = (1 / (1 + np.exp(-np.clip(y, -30, 30))) - label[order[i : i + 128]]).astype(np.float32) / len(b)
            grads = [g.sum(keepdims=True), b.T @ g, b.T @ (g[:, None] * s) - v * ((b**2).T @ g)[:, None]]
            t += 1
            for k in range(3):
                d = grads[k] + decay[k] * params[k]
                first[k] = 0.9 * first[k] + 0.1 * d
                second[k] = 0.999 * second[k] + 0.001 * d * d
                params[k] = params[k] - rate * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)
    return Machine(mean, scale, float(params[0][0]), params[1], params[2])


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, part in text.slices(batch.column(0)):
            present, stats = features(part)
            bits = pa.array([x.tobytes() for x in np.minimum(present, 65535).astype(np.uint16)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(1).slice(at, len(part)), bits, pa.array([x.tobytes() for x in stats], pa.binary())], names=["label", "words", "stats"])


def train(docs: DataFrame, labels: DataFrame, *, modulus: int = 5, held_out: int = 0, at_most: int = AT_MOST, id_col: str = "doc_id", text_col: str = "text") -> Machine:
    """Fits a machine on about ``at_most`` labelled rows at most, without those that are held out."""
    ship(docs.sparkSession)
    drawn = labelled.with_texts(labelled.sample(labels, "quality", modulus=modulus, held_out=held_out, at_most=at_most, id_col=id_col), docs, id_col=id_col, text_col=text_col)
    rows = drawn.mapInArrow(_examples, "label int, words binary, stats binary").toArrow()
    if not rows.num_rows:
        return fit(np.zeros((0, BUCKETS), np.float32), np.zeros((0, len(STATISTICS)), np.float32), np.zeros(0))
    words, stats = (rows[c].to_pylist() for c in ("words", "stats"))
    order = sorted(range(len(words)), key=lambda i: (stats[i], words[i]))  # the order in which tasks end must not count
    present = np.frombuffer(b"".join(words[i] for i in order), np.uint16).reshape(len(order), -1).astype(np.float32)
    stats = np.frombuffer(b"".join(stats[i] for i in order), np.float32).reshape(len(order), -1)
    return fit(present, stats, rows["label"].to_numpy()[order].astype(np.float32))


def score(docs: DataFrame, machine: Machine, *, modulus: int = 5, held_out: int = 0, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ``held_out``, ``score`` (0 to 1) and ``predicted`` (1 from the threshold on) of each row.

    Null and empty texts get the score of a text without words. Repeated rows each give a row; other columns are not
    read; an empty table gives no rows. A null id is never held out unless the empty text's remainder is.
    """
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(machine)  # of a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text.small(batches):
            for at, part in text.slices(batch.column(2)):
                value = shared.value.score(*features(part)).astype(np.float64)
                yield pa.RecordBatch.from_arrays([*(c.slice(at, len(part)) for c in batch.columns[:2]), pa.array(value)], names=["id", "held_out", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), (labelled.remainder(id_col, modulus) == held_out).alias("held_out"), F.col(text_col).alias("text"))
    scored = rows.mapInArrow(run, f"id {kind}, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int")).withColumnRenamed("id", id_col)


def keep_good(docs: DataFrame, machine: Machine, *, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows, all columns as they are, whose score reaches the threshold."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text.small(batches):
            kept = [shared.value.score(*features(part)) >= threshold for _, part in text.slices(batch.column(at))]
            yield batch.filter(pa.array(np.concatenate(kept))) if kept else batch

    at = docs.columns.index(text_col)
    return docs.mapInArrow(run, docs.schema)
