"""Byte-level BPE over overlapping chunks, and its decoding.

A text is cut into overlapping chunks, each of which is pre-tokenised on its own. Two scans that share one pre-token
boundary agree from there on, since a match depends only on what follows it; so neighbouring chunks are stitched at a
boundary that both have in their overlap, and the text's pre-tokens are those of one scan over all of it. Each pre-token
is then encoded by its ranks. Matches that reach the end of a chunk that isn't the last are not trusted. A text whose
chunks never meet (one pre-token longer than an overlap) is scanned in one go, exactly but in one task.

Chunks of ordinary texts are stitched in the task that reads them. Long texts are dealt out as rows of larger chunks,
which any task may scan, and their ids come together in order.

Decoding takes each id's bytes from a table and concatenates them.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import ship

#: Code points in a chunk besides its overlap, and in an overlap.
CHUNK, OVERLAP = 1 << 11, 1 << 7
#: The same of chunks that are rows of their own, for texts of more than one of them.
DEALT, DEALT_OVERLAP = 1 << 16, 1 << 10
#: The farthest that a match of a contraction looks ahead, in code points.
AHEAD = 4
#: Pre-tokens whose ids a worker remembers.
REMEMBERED = 300_000
#: Code points encoded between two writes to Spark.
EMIT = 1 << 21

#: The columns after the id that each kind of answer has.
ANSWERS = {"ids": "ids array<int>", "verified": "ids array<int>, decoded_sha256 string", "digests": "n_tokens long, ids_sha256 string, decoded_sha256 string, n_chunks long"}

_vocabularies: dict[tuple[str, str], Vocabulary] = {}


class Vocabulary(dict):
    """ids of pre-tokens, as little-endian 32-bit bytes, remembered within a bound."""

    def __init__(self, ranks: bytes, pattern: str):
        super().__init__()
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        by_id = [b""] * (max(table.values()) + 1)
        for token, rank in table.items():
            by_id[rank] = token
        self.tokens, self.scan = pa.array(by_id, pa.binary()), regex.compile(pattern).findall

    def __missing__(self, piece: str) -> bytes:
        ids = np.asarray(self.encoding._encode_single_piece(piece), dtype="<i4").tobytes()
        if len(self) >= REMEMBERED:
            self.clear()
        if len(piece) <= 64:
            self[piece] = ids
        return ids

    @classmethod
    def of(cls, ranks: bytes, pattern: str) -> Vocabulary:
        key = (hashlib.sha256(ranks).hexdigest(), pattern)
        if key not in _vocabularies:
            _vocabularies[key] = cls(ranks, pattern)
        return _vocabularies[key]

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, self.scan(text) if len(text) <= CHUNK + OVERLAP else self.pieces(text)))

    def pieces(self, text: str) -> list[str]:
        """The text's pre-tokens from its chunks; from a scan of all of it where two neighbours never meet."""
        out, held, at = [], [], 0
        for base in bases(len(text), CHUNK, OVERLAP):
            found = self.scan(text[base : base + CHUNK + OVERLAP])
            if base:
                # The last boundaries of the chunk before, from the end of what is trusted to where this chunk begins.
                ends, i = {}, len(held)
                while i and at > base:
                    if at <= base + OVERLAP - AHEAD:
                        ends[at] = i
                    i -= 1
                    at -= len(held[i])
                here = base
                for j, piece in enumerate(found):
                    here += len(piece)
                    if here in ends or here > base + OVERLAP:
                        break
                if here not in ends:
                    return self.scan(text)
                out += held[: ends[here]]
                found = found[j + 1 :]
            else:
                here = 0
            held, at = found, here + sum(map(len, found))
        return out + held

    def decode(self, lists: pa.ListArray) -> list[bytes]:
        """The bytes of each list of ids."""
        offsets = lists.offsets.to_numpy()
        joined = self.tokens.take(lists.values.slice(offsets[0], offsets[-1] - offsets[0]))
        if not len(joined):
            return [b""] * len(lists)
        at = np.frombuffer(joined.buffers()[1], dtype=np.int32)[joined.offset :][offsets - offsets[0]]
        data = memoryview(joined.buffers()[2])
        return [bytes(data[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def bases(n: int, chunk: int, overlap: int) -> range:
    """Where the chunks of a text of n code points begin."""
    return range(0, max(1, n - overlap), chunk)


def id_lists(encoded: list[bytes]) -> pa.ListArray:
    ends = np.cumsum([0, *(len(x) // 4 for x in encoded)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(encoded), dtype="<i4")))


def _parts(batch: pa.RecordBatch, column: int) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """A batch in parts of about EMIT code points, with the texts of each; null counts as empty."""
    at, held, size = 0, [], 0
    for i, x in enumerate(batch.column(column)):
        held.append(x.as_py() or "")
        size += len(held[-1])
        if size >= EMIT or i + 1 == batch.num_rows:
            yield batch.slice(at, len(held)), held
            at, held, size = i + 1, [], 0


def _encode_whole(ranks, pattern: str, answer: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary.of(ranks.value, pattern)
        for batch in batches:
            for part, texts in _parts(batch, 1):
                lists = id_lists([vocabulary.encode(x) for x in texts])
                chunks = pa.array([len(bases(len(x), CHUNK, OVERLAP)) for x in texts], pa.int64())
                yield _answer(part.column(0), lists, chunks, vocabulary, answer)

    return run


def _answer(ids: pa.Array, lists: pa.ListArray, chunks: pa.Array, vocabulary: Vocabulary, answer: str) -> pa.RecordBatch:
    if answer == "ids":
        return pa.RecordBatch.from_arrays([ids, lists], names=["id", "ids"])
    ends, values = lists.offsets.to_numpy(), lists.values.to_numpy()
    spoken = [] if answer == "verified" else [hashlib.sha256(" ".join(map(str, values[a:b].tolist())).encode()).hexdigest() for a, b in zip(ends[:-1], ends[1:], strict=True)]
    raw = [hashlib.sha256(x).hexdigest() for x in vocabulary.decode(lists)]
    if answer == "verified":
        return pa.RecordBatch.from_arrays([ids, lists, pa.array(raw)], names=["id", "ids", "decoded_sha256"])
    return pa.RecordBatch.from_arrays([ids, pa.array(np.diff(ends).astype(np.int64)), pa.array(spoken), pa.array(raw), chunks], names=["id", "n_tokens", "ids_sha256", "decoded_sha256", "n_chunks"])


def chunk_scan(text: str, last: bool, vocabulary: Vocabulary) -> tuple[list[int], list[bytes]]:
    """Where the trusted pre-tokens of a chunk start, with one more boundary at their end, and the ids of each."""
    pieces = vocabulary.scan(text)
    starts = [0, *np.cumsum([len(x) for x in pieces]).tolist()]
    sure = len(text) if last else len(text) - AHEAD
    while len(pieces) and starts[-1] > sure:
        starts.pop()
        pieces.pop()
    return starts, [vocabulary[x] for x in pieces]


def stitch(bases: list[int], scans: list[tuple[list[int], list[bytes]]]) -> bytes | None:
    """The ids of a whole text from the scans of its chunks; None if two neighbours share no boundary."""
    out, at = [], 0
    for k, (base, (starts, ids)) in enumerate(zip(bases, scans, strict=True)):
        here = {base + s: i for i, s in enumerate(starts)}
        if at not in here:
            return None
        if k + 1 == len(bases):
            until = base + starts[-1]
        else:
            after = {bases[k + 1] + s for s in scans[k + 1][0][1:]}
            until = next((base + s for s in starts[here[at] :] if base + s in after), None)
            if until is None:
                return None
        out += ids[here[at] : here[until]]
        at = until
    return b"".join(out)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of chunks; each text gets a name of its own, also where rows repeat."""
    for batch in batches:
        for row, id_, text in zip(*batch.columns, strict=True):
            body = text.as_py()
            at = bases(len(body), DEALT, DEALT_OVERLAP)
            for k in at:
                columns = [row.as_py()], [id_.as_py()], [k], [k == at[-1]], [body[k : k + DEALT + DEALT_OVERLAP]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), batch.schema.field(1).type, pa.int64(), pa.bool_(), pa.string()), strict=True)], names=["row", "id", "base", "last", "chunk"])


def _scan_chunks(ranks, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary.of(ranks.value, pattern)
        for batch in batches:
            for part, texts in _parts(batch, 4):
                scans = [chunk_scan(x, last, vocabulary) for x, last in zip(texts, part.column(3).to_pylist(), strict=True)]
                starts = pa.array([s for s, _ in scans], pa.list_(pa.int64()))
                counts = pa.array([[len(x) // 4 for x in i] for _, i in scans], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.columns, starts, counts, id_lists([b"".join(i) for _, i in scans])], names=["row", "id", "base", "last", "chunk", "starts", "counts", "ids"])

    return run


def _stitch_rows(ranks, pattern: str, answer: str):
    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        vocabulary = Vocabulary.of(ranks.value, pattern)
        rows = rows.sort_by("base").combine_chunks()
        scans = []
        for starts, counts, ids in zip(rows["starts"].to_pylist(), rows["counts"].to_pylist(), rows["ids"], strict=True):
            flat = ids.values.to_numpy().astype("<i4").tobytes()
            ends = np.cumsum([0, *counts]).tolist()
            scans.append((starts, [flat[4 * a : 4 * b] for a, b in zip(ends[:-1], ends[1:], strict=True)]))
        joined = stitch(rows["base"].to_pylist(), scans)
        if joined is None:
            chunks = rows["chunk"].to_pylist()
            joined = vocabulary.encode("".join(x[:DEALT] for x in chunks[:-1]) + chunks[-1])
        told = _answer(rows["id"].combine_chunks().slice(0, 1), id_lists([joined]), pa.array([rows.num_rows], pa.int64()), vocabulary, answer)
        return pa.Table.from_batches([told]).add_column(0, "row", pa.array([key[0].as_py()]))

    return run


def _encoded(docs: DataFrame, ranks_path: str, pattern: str, id_col: str, text_col: str, answer: str) -> DataFrame:
    spark = docs.sparkSession
    ship(spark)
    with open(ranks_path, "rb") as f:  # an installed vocabulary file of a fixed size, read where the driver runs
        ranks = spark.sparkContext.broadcast(f.read())
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, {ANSWERS[answer]}"
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    n: Column = F.length("text")
    short = rows.where(n.isNull() | (n <= DEALT + DEALT_OVERLAP)).mapInArrow(_encode_whole(ranks, pattern, answer), schema)
    # Long rows that repeat as a whole are encoded once, and their number is put back at the end.
    long_ = rows.where(n > DEALT + DEALT_OVERLAP).withColumn("row", F.sha2(F.concat_ws(" ", F.length(F.col("id").cast("string")), F.col("id").cast("string"), "text"), 256))
    times = long_.groupBy("row").agg(F.count(F.lit(1)).alias("times"))
    chunks = long_.select("row", "id", "text").mapInArrow(_cut, f"row string, id {kind}, base long, last boolean, chunk string")
    chunks = chunks.dropDuplicates(["row", "base"])  # a shuffle: chunks are dealt over all tasks
    scanned = chunks.mapInArrow(_scan_chunks(ranks, pattern), f"row string, id {kind}, base long, last boolean, chunk string, starts array<long>, counts array<int>, ids array<int>")
    stitched = scanned.groupBy("row").applyInArrow(_stitch_rows(ranks, pattern, answer), f"row string, {schema}")
    again = stitched.join(times, "row").withColumn("_", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    return short.unionByName(again.select(*short.columns)).withColumnRenamed("id", id_col)


def encode(docs: DataFrame, ranks_path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and ``ids`` array<int> of each row, as an encoder of the whole text without special tokens would give them.

    Null and empty texts have no ids. Repeated rows and ids each give a row. Other columns are not read; an empty table
    gives no rows. Texts of any length are encoded whole.
    """
    return _encoded(docs, ranks_path, pattern, id_col, text_col, "ids")


def encode_and_decode(docs: DataFrame, ranks_path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As ``encode``, with ``decoded_sha256``: the SHA-256 of the bytes that the ids decode to."""
    return _encoded(docs, ranks_path, pattern, id_col, text_col, "verified")


def digests(docs: DataFrame, ranks_path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As ``encode`` and then ``decode``, with the number of ids, the SHA-256 of ids and of decoded
    bytes, and the number of chunks in their place."""
    return _encoded(docs, ranks_path, pattern, id_col, text_col, "digests")


def decode(encoded: DataFrame, ranks_path: str, pattern: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """The id and the ``bytes`` that each row's ids stand for; null counts as no ids. Bytes needn't be UTF-8."""
    spark = encoded.sparkSession
    ship(spark)
    with open(ranks_path, "rb") as f:
        ranks = spark.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary.of(ranks.value, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                lists = part.column(1).fill_null(pa.scalar([], part.column(1).type)) if part.column(1).null_count else part.column(1)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(vocabulary.decode(lists), pa.binary())], names=["id", "bytes"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(F.col(id_col).alias("id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(run, f"id {kind}, bytes binary").withColumnRenamed("id", id_col)
