"""Token ids in sorted-string-table shards.

A shard is one file, so laid out (integers little-endian unless said otherwise):

    block*   entries: varint bytes shared with the key before, varint bytes that follow, varint number of ids,
             the key's bytes that follow, the ids (16 or 32 bits each); the first key of a block is whole
    index    a row per block: first key (8 bytes, big-endian), offset, bytes, entries (64 bits each)
    bloom    bits of a Bloom filter over the keys
    footer   FOOTER: places and sizes of the parts, sum of ids, first and last key, partition, number in the
             partition, CRC-32 of all before the footer, MAGIC

Keys are document ids as 8 big-endian bytes with the sign bit flipped, so byte order is the order of ids; a null id is
the key of no bytes, before all others. A manifest beside the shards tells the range of ids of each file. A look-up opens
the files whose range has the key, asks the filter, then bisects the index, then reads one block.
The files are written and read through Spark, and so lie wherever Spark can write.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import unicodedata
import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .shared import scratch, ship
from .text import U, mix

#: The last byte of each file is the line end that Spark's text writer puts after a value.
MAGIC = b"TIDESST1\n"
FOOTER = struct.Struct("<QQQQQQQQQqqIIB3xI9s")
#: Aims for the size of a block, and of the documents in a shard, in bytes. A larger document is alone in its block. A
#: task holds about five times a shard, so larger ones, of which a store has fewer, need larger executors.
BLOCK_BYTES, SHARD_BYTES = 1 << 15, 8 << 20
BITS_A_KEY, PROBES = 10, 7
#: Runs, and pre-tokens, whose ids a worker remembers. Frequent ones come early, so nothing is forgotten for later ones.
RUNS, PIECES = 300_000, 800_000

_tokenizers: dict[str, Words] = {}


class Pieces(dict):
    """ids of pre-tokens by the tokenizer's own model, as little-endian 32-bit bytes, remembered within a bound."""

    def __init__(self, tokenizer: Tokenizer):
        super().__init__()
        self.model = tokenizer.model

    def __missing__(self, piece: str) -> bytes:
        mapped = piece if piece.isascii() else "".join(_BYTE_LETTERS[b] for b in piece.encode())
        ids = struct.pack(f"<{len(t := self.model.tokenize(mapped))}I", *(x.id for x in t))
        if len(self) < PIECES and len(piece) <= 64:
            self[piece] = ids
        return ids


def _byte_letters() -> list[str]:
    """The letter that byte-level tokenizers put for each byte: printable Latin-1 stays, the rest follow U+0100 in order."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    odd = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(odd)) for b in range(256)]


_BYTE_LETTERS = _byte_letters()
#: The characters of which runs are split here: those of Latin scripts, which are the same in all Unicode forms.
_LATIN = [chr(c) for c in (*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x130), *range(0x132, 0x180))]
_of = lambda kind: "".join(c for c in _LATIN if unicodedata.category(c)[0] == kind)
_OTHER = "".join(c for c in _LATIN if unicodedata.category(c)[0] not in "LN")


#: The normaliser and the splitter of which runs are split here; other definitions encode whole texts.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}
_BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}


def splits_as_here(definition: bytes) -> bool:
    """Whether a tokenizer's definition has the normaliser, the splitter and the kind of special tokens expected here."""
    d = json.loads(definition)
    special = all(t["content"].startswith("<|") and t["special"] and not t["normalized"] for t in d.get("added_tokens") or [])
    plain = not any(d.get(k) for k in ("truncation", "padding")) and (d.get("model") or {}).get("type") == "BPE" and not d["model"].get("dropout")
    return special and plain and d.get("normalizer") == _NORMALIZER and d.get("pre_tokenizer") == {"type": "Sequence", "pretokenizers": [_SPLIT, _BYTES]}


class Words(dict):
    """ids of runs between white space, as little-endian 32-bit bytes, remembered within a bound.

    The tokenizer's pre-tokens hold no white space and its normaliser works within runs, so a text's ids are those of
    its runs. A run of Latin characters is lower-cased and split by the tokenizer's pattern, and its pre-tokens go to
    the tokenizer's model; any other run goes through the whole tokenizer. Texts for which Python and the tokenizer
    may see other runs, or with a special token, are encoded whole; all texts are if the definition is another.
    """

    aside = re.compile(r"[\x1c-\x1f]|<\|").search
    latin = re.compile(f"[{re.escape(''.join(_LATIN))}]+").fullmatch
    #: Fixed value: the tokenizer's own pattern, over these characters.
    split = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_of('L')}]+|[{_of('N')}]|[{re.escape(_OTHER)}]+").findall

    def __init__(self, definition: bytes):
        super().__init__()
        self.tokenizer = Tokenizer.from_buffer(definition)
        self.pieces, self.by_runs = Pieces(self.tokenizer), splits_as_here(definition)

    def whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def __missing__(self, run: str) -> bytes:
        ids = b"".join(map(self.pieces.__getitem__, self.split(run.lower()))) if self.latin(run) else self.whole(run)
        if len(self) < RUNS and len(run) <= 64:
            self[run] = ids
        return ids

    def encode(self, text: str) -> bytes:
        return self.whole(text) if not self.by_runs or self.aside(text) else b"".join(map(self.__getitem__, text.split()))

    @classmethod
    def of(cls, definition: bytes) -> Words:
        key = hashlib.sha256(definition).hexdigest()
        if key not in _tokenizers:
            _tokenizers[key] = cls(definition)
        return _tokenizers[key]


def key_of(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else (doc_id + (1 << 63)).to_bytes(8, "big")


def id_of(key: bytes) -> int | None:
    return int.from_bytes(key, "big") - (1 << 63) if key else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        shift += 7
        if b < 128:
            return n, at


def _probes(keys: list[bytes], bits: int) -> np.ndarray:
    h = np.array([int.from_bytes(k.rjust(8, b"\0"), "big") ^ len(k) for k in keys], dtype=U)
    a, b = mix(h), mix(h ^ U(0xA24BAED4963EE407)) | U(1)
    return (a[:, None] + b[:, None] * np.arange(PROBES, dtype=U)) % U(bits)


def build(entries: list[tuple[bytes, bytes]], partition: int, number: int) -> bytes:
    """A shard's file, without its last byte, from ascending keys with their ids as little-endian 32-bit bytes."""
    width = 2 if all(len(v) == 0 or np.frombuffer(v, dtype="<u4").max() < 1 << 16 for _, v in entries) else 4
    blocks, index, total, block, first, n, last = [], [], 0, bytearray(), b"", 0, b""
    offset = 0

    def close() -> None:
        nonlocal offset, block, n
        index.append(struct.pack(">Q", int.from_bytes(first, "big")) + struct.pack("<QQQ", offset, len(block), n))
        blocks.append(bytes(block))
        offset, block, n = offset + len(block), bytearray(), 0

    for key, value in entries:
        if n and len(block) + len(value) * width // 4 > BLOCK_BYTES:
            close()
        shared = 0
        if n:
            while shared < min(len(key), len(last)) and key[shared] == last[shared]:
                shared += 1
        else:
            first = key
        block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value) // 4) + key[shared:]
        block += np.frombuffer(value, dtype="<u4").astype("<u2").tobytes() if width == 2 else value
        n, last, total = n + 1, key, total + len(value) // 4
    close()
    bits = max(64, BITS_A_KEY * len(entries))
    bloom = np.zeros(bits, dtype=bool)
    bloom[_probes([k for k, _ in entries], bits).ravel().astype(np.int64)] = True
    filtered = np.packbits(bloom, bitorder="little").tobytes()
    table = b"".join(index)
    body = b"".join(blocks) + table + filtered
    low, high = (id_of(k) if k else -(1 << 63) for k in (entries[0][0], entries[-1][0]))
    footer = FOOTER.pack(offset, len(table), len(filtered), bits, len(blocks), len(entries), total, BITS_A_KEY, PROBES, low, high, partition, number, width, zlib.crc32(body), MAGIC)
    return body + footer[:-1]


class Shard:
    """A file, of which ``read(at, n)`` gives n bytes: the footer and the index at once, blocks when they are asked for."""

    def __init__(self, read: Callable[[int, int], bytes], size: int):
        self.read, footer = read, read(size - FOOTER.size, FOOTER.size)
        (self.blocks_end, self.index_bytes, self.bloom_bytes, self.bits, self.n_blocks, self.n_docs, self.n_ids, _, _, self.low, self.high, self.partition, self.number, self.width, self.crc, magic) = FOOTER.unpack(footer)
        if magic != MAGIC:
            raise ValueError("not a shard of token ids")
        table = read(self.blocks_end, self.index_bytes)
        self.index = [(int.from_bytes(table[i : i + 8], "big"), *struct.unpack("<QQQ", table[i + 8 : i + 32])) for i in range(0, self.index_bytes, 32)]

    @classmethod
    def of(cls, data) -> Shard:
        """A shard whose bytes are all at hand, checked against its footer."""
        out = cls(lambda at, n: data[at : at + n], len(data))
        if zlib.crc32(data[: -FOOTER.size]) != out.crc:
            raise ValueError("a shard's bytes don't match its checksum")
        return out

    def block(self, i: int) -> Iterator[tuple[bytes, np.ndarray]]:
        _, start, size, n = self.index[i]
        data, at, key = self.read(start, size), 0, b""
        for _ in range(n):
            shared, at = _read_varint(data, at)
            rest, at = _read_varint(data, at)
            count, at = _read_varint(data, at)
            key = key[:shared] + bytes(data[at : at + rest])
            at += rest
            yield key, np.frombuffer(data, dtype=f"<u{self.width}", count=count, offset=at)
            at += count * self.width

    def __iter__(self) -> Iterator[tuple[bytes, np.ndarray]]:
        for i in range(self.n_blocks):
            yield from self.block(i)

    def may_hold(self, key: bytes) -> bool:
        at = self.blocks_end + self.index_bytes
        return all(self.read(at + p // 8, 1)[0] >> p % 8 & 1 for p in _probes([key], self.bits)[0].tolist())

    def get(self, key: bytes) -> list[np.ndarray]:
        """The ids of each entry of a key."""
        if not self.may_hold(key):
            return []
        firsts = [x[0] for x in self.index]
        i = max(0, bisect_right(firsts, int.from_bytes(key, "big")) - 1)
        while i and self.index[i][0] == int.from_bytes(key, "big"):
            i -= 1
        found = []
        for j in range(i, self.n_blocks):
            for k, ids in self.block(j):
                if k == key:
                    found.append(ids)
                elif k > key:
                    return found
        return found


def _shards(definition, end_id: int | None, shard_bytes: int):
    end = b"" if end_id is None else struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, partition = Words.of(definition.value), TaskContext.get().partitionId()
        held, size, number = [], 0, 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = words.encode(text.as_py() or "") + end
                if held and size + len(ids) > 2 * shard_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([build(held, partition, number)], pa.binary())], names=["file"])
                    held, size, number = [], 0, number + 1
                held.append((key_of(doc_id), ids))
                size += len(ids)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([build(held, partition, number)], pa.binary())], names=["file"])

    return run


def write(docs: DataFrame, path: str, tokenizer_path: str, *, end_id: int | None = 1, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> None:
    """Encodes each text without special tokens, puts ``end_id`` after it, and writes the shards in ascending order of ids.

    A null or empty text has the end id only. Rows that repeat an id stay apart, in the order of hashes of their texts,
    by which an id of very many rows is dealt out too; a null id comes first. Other columns are not read; an empty table
    writes no shard. Documents are dealt by ranges of ids.
    """
    spark = docs.sparkSession
    ship(spark)
    with open(tokenizer_path, "rb") as f:  # an installed definition of a fixed size, read where the driver runs
        definition = spark.sparkContext.broadcast(f.read())
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    hashed = rows.withColumn("h", F.xxhash64("text")).repartitionByRange(F.asc_nulls_first("id"), F.asc("h"))
    ordered = hashed.sortWithinPartitions(F.asc_nulls_first("id"), F.asc("h"), F.asc_nulls_first("text"))
    files = ordered.select("id", "text").mapInArrow(_shards(definition, end_id, shard_bytes), "file binary")
    files.select(F.col("file").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).text(path)


def _list(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column(0), batch.column(1), strict=True):
            shard, start = Shard.of(content.as_buffer()), 0
            rows = []
            for key, ids in shard:
                rows.append((id_of(key), start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                start += len(ids)
            columns = [pa.array(x, pa.int64()) for x in zip(*rows, strict=True)]
            place = [pa.array(np.full(len(rows), x, dtype=np.int64)) for x in (shard.partition, shard.number)]
            yield pa.RecordBatch.from_arrays([*columns, *place, pa.array([path.as_py()] * len(rows), pa.string())], names=["id", "at", "n", "crc", "partition", "number", "file"])


def _listed(spark: SparkSession, path: str) -> DataFrame:
    """A row for each entry of the shards, as read back from them: kept beside them."""
    listed = f"{path}-listed"
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    files.mapInArrow(_list, "id long, at long, n long, crc long, partition long, number long, file string").write.mode("overwrite").parquet(listed)
    return spark.read.parquet(listed)


def catalogue(spark: SparkSession, path: str, *, id_col: str = "doc_id") -> DataFrame:
    """What the shards hold, read back from them: id, ``start`` (ids of all documents before it), ``n_tokens``, ``ids_crc32``."""
    ship(spark)
    rows = _listed(spark, path)
    shards = rows.groupBy("partition", "number").agg(F.sum("n").alias("ids"))
    within = Window.partitionBy("partition").orderBy("number")
    shards = shards.withColumn("before", F.sum("ids").over(within) - F.col("ids"))
    parts = rows.groupBy("partition").agg(F.sum("n").alias("all"))
    parts = parts.withColumn("earlier", F.sum("all").over(Window.orderBy("partition")) - F.col("all"))
    place = shards.join(parts, "partition").select("partition", "number", (F.col("before") + F.col("earlier")).alias("base"))
    out = rows.join(place, ["partition", "number"])
    return out.select(F.col("id").alias(id_col), (F.col("base") + F.col("at")).alias("start"), F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32"))


def write_manifest(spark: SparkSession, path: str) -> None:
    """``file``, ``low``, ``high``, ``n_docs`` of each shard, beside the shards, from one reading of them."""
    ship(spark)
    _listed(spark, path).groupBy("file").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count(F.lit(1)).alias("n_docs")).write.mode("overwrite").parquet(f"{path}-manifest")


def _holding(spark: SparkSession, path: str, wanted: list[int]) -> list[str]:
    """The files whose range has one of the ids, by the manifest."""
    manifest = spark.read.parquet(f"{path}-manifest")
    has = F.exists(F.lit(wanted), lambda x: (x >= F.col("low")) & (x <= F.col("high")))
    return [r.file for r in manifest.where(has).select("file").collect()]  # few by the number of ids asked for


def lookup(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """The ids of the given documents, of which there are few: only the files that the manifest names are read, in tasks."""
    ship(spark)
    wanted = sorted(set(doc_ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                shard = Shard.of(content.as_buffer())
                hits = [(d, ids.astype(np.int64)) for d in wanted if shard.low <= d <= shard.high for ids in shard.get(key_of(d))]
                yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in hits], pa.int64()), pa.array([i for _, i in hits], pa.list_(pa.int64()))], names=["doc_id", "ids"])

    files = _holding(spark, path, wanted) if wanted else []
    if not files:
        return spark.createDataFrame([], "doc_id long, ids array<long>")
    return spark.read.format("binaryFile").load(files).select("content").mapInArrow(run, "doc_id long, ids array<long>")


def get(spark: SparkSession, path: str, doc_id: int) -> list[np.ndarray]:
    """The ids of each row of one document: footer, index, filter and one block are read by their offsets, from here."""
    jvm, found = spark.sparkContext._jvm, []
    for name in _holding(spark, path, [doc_id]):
        file = jvm.org.apache.hadoop.fs.Path(name)
        system = file.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        stream = system.open(file)

        def read(at: int, n: int, stream=stream) -> bytes:
            stream.seek(at)
            return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream, n)) if n else b""

        try:
            found += Shard(read, system.getFileStatus(file).getLen()).get(key_of(doc_id))
        finally:
            stream.close()
    return found


def roundtrip(docs: DataFrame, tokenizer_path: str, *, end_id: int | None = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes shards to the shared folder and lists them."""
    path = scratch(docs.sparkSession, "sstable")
    write(docs, path, tokenizer_path, end_id=end_id, id_col=id_col, text_col=text_col)
    return catalogue(docs.sparkSession, path, id_col=id_col)
