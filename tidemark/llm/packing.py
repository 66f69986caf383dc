"""Packing of tokenised documents into windows by the sum-of-squares rule, each task its own documents, online.

A level array counts the partially filled windows of each fill level. A document goes to the level, or to a new window,
that leaves the sum of the squared counts least: few windows of one level stay open, so what is to come finds room.
Documents of a window or more give whole windows first, and only their rest is placed.

A task holds the tokens of its open windows only. When there are too many of them, and at the end, they are closed: the
fullest take pieces cut off the emptiest until they are full. What is left of the very last window is cut into windows of
powers of two, so none is padded. No row moves between tasks.

Texts are split by the pattern of byte-level tokenizers, its classes written out, and pre-tokens are encoded by the ranks
of the tokenizer's own merges and remembered (see ``byte_bpe``). Characters whose kind changed between editions of Unicode
may be of another kind to the tokenizer, so texts that hold any, and all texts under other definitions, are encoded by
the tokenizer itself.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .byte_bpe import Vocabulary, id_lists
from .byte_bpe import _parts as parts
from .shared import ship
from .sstable import _BYTE_LETTERS

#: Tokens in a window, and windows that a task keeps open: 4096 of them hold at most 32 MiB of ids.
WINDOW, MOST_OPEN = 2048, 4096
#: Fixed value: how byte-level tokenizers split a text.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Sequences of a task are numbered from its partition's number times this.
SPREAD = 1 << 36
#: Pieces sent to Spark at once.
EMIT = 4096
#: Code points that are split at once.
LONG = 1 << 16

_encoders: dict[str, Encoder] = {}


def ranks_of(definition: dict) -> bytes | None:
    """The ranks of a byte-level tokenizer's merges, in the form of a rank file; None if it is another kind of tokenizer."""
    model, split = definition.get("model") or {}, definition.get("pre_tokenizer") or {}
    if model.get("type") != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
        return None
    if split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
        return None
    if any(definition.get(k) for k in ("normalizer", "truncation", "padding")):
        return None
    if any(t.get(k) for t in definition.get("added_tokens") or [] for k in ("single_word", "lstrip", "rstrip", "normalized")):
        return None
    letters = {letter: b for b, letter in enumerate(_BYTE_LETTERS)}
    vocab, merges = model["vocab"], [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    if any(x not in vocab for x in letters) or len(vocab) != len(letters) + len(merges) or any(set(t) - set(letters) for t in vocab):
        return None
    # Ranks say which merge goes first by the id of what it makes: merges must be in the order of ids.
    made = [vocab.get(a + b, -1) for a, b in merges]
    if made != sorted(set(made)) or max(vocab[x] for x in letters) > min(made, default=len(vocab)):
        return None
    return b"\n".join(base64.b64encode(bytes(letters[c] for c in t)) + b" %d" % i for t, i in vocab.items())


def _kind(c: str, edition) -> str:
    """L, N, Z or neither: all that the pattern tells apart, besides control characters that are spaces."""
    return edition.category(c)[0].translate({ord(x): None for x in "CMPS"})


def _class(chars: list[str]) -> str:
    """Ascending characters as ranges of a pattern's class."""
    out, i = [], 0
    while i < len(chars):
        j = i
        while j + 1 < len(chars) and ord(chars[j + 1]) == ord(chars[j]) + 1:
            j += 1
        out.append(f"\\u{ord(chars[i]):04x}-\\u{ord(chars[j]):04x}")
        i = j + 1
    return "".join(out)


#: Characters of the basic plane that are of the same kind in the oldest edition of Unicode at hand and in this one.
_SETTLED = [c for c in map(chr, (*range(0xD800), *range(0xE000, 0x10000))) if unicodedata.ucd_3_2_0.category(c) != "Cn" and _kind(c, unicodedata) == _kind(c, unicodedata.ucd_3_2_0)]


def _pattern() -> str:
    """The pattern over settled characters, its classes written out."""
    letters, numbers = (_class([c for c in _SETTLED if _kind(c, unicodedata) == k]) for k in "LN")
    spaces = _class([c for c in _SETTLED if _kind(c, unicodedata) == "Z" or c in "\t\n\v\f\r\x85"])
    return PATTERN.replace("[^\\s\\p{L}\\p{N}]", f"[^{spaces}{letters}{numbers}]").replace("\\p{L}", f"[{letters}]").replace("\\p{N}", f"[{numbers}]").replace("\\s", f"[{spaces}]").replace("\\S", f"[^{spaces}]")


class Encoder:
    """ids of texts as little-endian 32-bit bytes, as the tokenizer gives them without adding special tokens."""

    def __init__(self, definition: bytes):
        self.tokenizer = Tokenizer.from_buffer(definition)
        parsed = json.loads(definition)
        ranks = ranks_of(parsed)
        self.vocabulary = None if ranks is None else Vocabulary.of(ranks, PATTERN)
        # A longer special token goes first where two begin alike, as the tokenizer takes the longest.
        self.special = {t["content"]: np.asarray([t["id"]], "<i4").tobytes() for t in parsed.get("added_tokens") or []}
        cut = "|".join(re.escape(t) for t in sorted(self.special, key=len, reverse=True))
        self.cut = re.compile(f"({cut})").split if cut else None
        self.aside = re.compile(f"[^{_class(_SETTLED)}]").search
        self.split, self.between = re.compile(_pattern()).findall, re.compile("[A-Za-z] (?=[A-Za-z])").search

    def whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<i4").tobytes()

    def plain(self, text: str) -> bytes:
        """The ids of settled characters. A long text is cut where one word ends and a space and the next word begin, as
        pre-tokens always are."""
        ids, of, at = [], self.vocabulary.__getitem__, 0
        while at < len(text):
            cut = self.between(text, at + LONG) if len(text) - at > LONG else None
            end = cut.start() + 1 if cut else len(text)
            ids.append(b"".join(map(of, self.split(text[at:end]))))
            at = end
        return b"".join(ids)

    def encode(self, text: str) -> bytes:
        if self.vocabulary is None or self.aside(text):  # a vocabulary that remembers nothing yet is an empty dict
            return self.whole(text)
        if not self.cut:
            return self.plain(text)
        return b"".join(self.special.get(x) or self.plain(x) for x in self.cut(text))

    @classmethod
    def of(cls, definition: bytes) -> Encoder:
        key = hashlib.sha256(definition).hexdigest()
        if key not in _encoders:
            _encoders[key] = cls(definition)
        return _encoders[key]


class Packer:
    """Windows of ``size`` tokens under the sum-of-squares rule. A piece is (document, start, ids); ``finished`` gives the
    windows that are full since it was last asked, each a list of pieces."""

    def __init__(self, size: int = WINDOW, most_open: int = MOST_OPEN):
        self.size, self.most_open = size, most_open
        self.counts = np.zeros(size + 1, dtype=np.int64)
        self.levels: list[list[list]] = [[] for _ in range(size)]
        self.open, self.full = 0, []

    def level(self, n: int) -> int:
        """The level to which n tokens are added, 0 for a new window: of those that do equally well the fullest."""
        before, after = self.counts[: self.size - n + 1], self.counts[n:]
        grows = 2 * (after - before) + 2  # from h to h + n: (N(h+n)+1)² - N(h+n)² + (N(h)-1)² - N(h)²
        grows[-1] = 1 - 2 * before[-1]  # a full window is counted no more
        grows[before == 0] = np.iinfo(np.int64).max
        grows[0] = 2 * after[0] + 1 if n < self.size else 0
        return len(grows) - 1 - int(np.argmin(grows[::-1]))

    def _keep(self, window: list, level: int) -> None:
        if level == self.size:
            self.full.append(window)
        else:
            self.levels[level].append(window)
            self.counts[level] += 1
            self.open += 1

    def add(self, document, ids: bytes) -> None:
        n = len(ids) // 4
        whole = n - n % self.size
        for at in range(0, whole, self.size):
            self.full.append([(document, at, ids[4 * at : 4 * (at + self.size)])])
        if n == whole:
            return
        rest = n - whole
        level = self.level(rest)
        window = []
        if level:
            window = self.levels[level].pop()
            self.counts[level] -= 1
            self.open -= 1
        window.append((document, whole, ids[4 * whole :]))
        self._keep(window, level + rest)
        if self.open > self.most_open:
            self.close()

    def close(self) -> None:
        """Fills the fullest windows with pieces cut off the emptiest; one partially filled window is left at most."""
        windows = [(window, level) for level in range(self.size - 1, 0, -1) for window in self.levels[level]]
        self.levels, self.open = [[] for _ in range(self.size)], 0
        self.counts[:] = 0
        i, j = 0, len(windows) - 1
        while i < j:
            window, level = windows[i]
            giver, left = windows[j]
            while level < self.size and giver:
                document, start, ids = giver.pop()
                n = min(len(ids) // 4, self.size - level)
                kept = len(ids) - 4 * n
                if kept:
                    giver.append((document, start, ids[:kept]))
                window.append((document, start + kept // 4, ids[kept:]))
                level, left = level + n, left - n
            windows[i], windows[j] = (window, level), (giver, left)
            if level == self.size:
                self.full.append(window)
                i += 1
            if not giver:
                j -= 1
        if i == j:
            self._keep(*windows[i])

    def end(self) -> None:
        """Closes all windows; the last is cut into windows of powers of two."""
        self.close()
        rest = [piece for level in self.levels for window in level for piece in window]
        left = sum(len(ids) for _, _, ids in rest) // 4
        self.levels, self.open = [[] for _ in range(self.size)], 0
        self.counts[:] = 0
        while left:
            room = 1 << (left.bit_length() - 1)
            left -= room
            window = []
            while room:
                document, start, ids = rest.pop(0)
                n = min(len(ids) // 4, room)
                window.append((document, start, ids[: 4 * n]))
                if 4 * n < len(ids):
                    rest.insert(0, (document, start + n, ids[4 * n :]))
                room -= n
            self.full.append(window)

    def finished(self) -> list[list]:
        out, self.full = self.full, []
        return out


def _run(definition, end_id: int, size: int, most_open: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer = Encoder.of(definition.value), Packer(size, most_open)
        end, number, held, kind = np.asarray([end_id], "<i4").tobytes(), TaskContext.get().partitionId() * SPREAD, [], None

        def take() -> None:
            nonlocal number
            for window in packer.finished():
                offset = 0
                for (id_, tokens), start, ids in window:
                    held.append((id_, start, len(ids) // 4, ids if with_ids else zlib.crc32(ids), tokens, number, offset))
                    offset += len(ids) // 4
                number += 1

        def told() -> pa.RecordBatch:
            ids, *numbers = (list(c) for c in zip(*((x[0], x[1], x[2], x[4], x[5], x[6], x[3]) for x in held), strict=True))
            last = id_lists(numbers.pop()) if with_ids else pa.array(numbers.pop(), pa.int64())
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(ids, kind), *(pa.array(x, pa.int64()) for x in numbers), last], names=["id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids" if with_ids else "ids_crc32"])

        for batch in batches:
            kind = batch.schema.field(0).type
            for part, texts in parts(batch, 1):
                for id_, text in zip(part.column(0).to_pylist(), texts, strict=True):
                    ids = encoder.encode(text) + end
                    packer.add((id_, len(ids) // 4), ids)
                    if len(packer.full) >= EMIT // 4:
                        take()
                    if len(held) >= EMIT:
                        yield told()
        packer.end()
        take()
        if held:
            yield told()

    return run


def _packed(docs: DataFrame, tokenizer_path: str, end_id: int, size: int, most_open: int, id_col: str, text_col: str, with_ids: bool) -> DataFrame:
    spark = docs.sparkSession
    ship(spark)
    with open(tokenizer_path, "rb") as f:  # an installed definition of a fixed size, read where the driver runs
        definition = spark.sparkContext.broadcast(f.read())
    kind = docs.schema[id_col].dataType.simpleString()
    last = "ids array<int>" if with_ids else "ids_crc32 long"
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(_run(definition, end_id, size, most_open, with_ids), f"id {kind}, start long, length long, doc_tokens long, sequence_id long, offset long, {last}")
    return out.withColumnRenamed("id", id_col)


def pack(docs: DataFrame, tokenizer_path: str, *, end_id: int, size: int = WINDOW, most_open: int = MOST_OPEN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of all documents: id, ``start`` (tokens of its document before it), ``length``, ``doc_tokens``,
    ``sequence_id``, ``offset`` (tokens of its sequence before it) and ``ids``.

    A document is its text's ids and then ``end_id``; null and empty texts are ``end_id`` alone. Each row is a document of
    its own, also where rows or ids repeat or the id is null. A sequence has ``size`` tokens but for the last of a task,
    which have powers of two; so none needs padding. Which documents share a sequence, and its number, depend on how the
    table is cut into tasks: a task that runs again packs alike as long as it reads the same rows in the same order, as
    from files. Other columns are not read; an empty table gives no rows.
    """
    return _packed(docs, tokenizer_path, end_id, size, most_open, id_col, text_col, True)


def digests(docs: DataFrame, tokenizer_path: str, *, end_id: int, size: int = WINDOW, most_open: int = MOST_OPEN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As ``pack``, with ``ids_crc32`` of the ids as unsigned 32-bit little-endian integers in place of ``ids``."""
    return _packed(docs, tokenizer_path, end_id, size, most_open, id_col, text_col, False)
