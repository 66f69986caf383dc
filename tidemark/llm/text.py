"""Words and shingles of whole Arrow string columns, hashed with numpy, without a Python step per word.

Texts are taken as UTF-8 bytes. A word is a longest run of bytes that a 256-entry class table accepts, so any
separator set made of ASCII characters gives the same words as a scan over code points. Word hashes are 64-bit
polynomials over the bytes, finished by an avalanche step; they depend on nothing but the word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 1 << 64)
#: Bytes hashed at once, which bounds the temporary arrays however long a text is.
SEGMENT = 1 << 20
#: Bytes of text handled at once by the operators; a longer text is handled alone.
SLICE = 1 << 21

_ASCII_LOWER = np.arange(256, dtype=np.uint8)
_ASCII_LOWER[65:91] += 32
#: Everything but the six ASCII white-space characters.
NON_SPACE = np.ones(256, dtype=bool)
NON_SPACE[[32, 9, 10, 11, 12, 13]] = False
#: ASCII letters and digits, and every byte of a character beyond ASCII; ``words`` leaves out punctuation among those.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(SEGMENT * 2, 1 << (n + 1).bit_length())
    if size not in _powers:
        _powers.clear()
        up, down = np.full(size, _P, dtype=U), np.full(size, _PINV, dtype=U)
        up[0] = down[0] = 1
        _powers[size] = (np.multiply.accumulate(up), np.multiply.accumulate(down))
    return _powers[size]


def mix(h: np.ndarray) -> np.ndarray:
    """Avalanche of 64-bit values, after Stafford's variant 13."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U(27))
    h = h * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def small(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Batches in parts of so many rows, lest copies of a whole batch be held at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


class Texts:
    """Consecutive texts as one byte array; ``offsets`` has the first byte of each and the end."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets

    def __len__(self) -> int:
        return len(self.offsets) - 1


def slices(column: pa.Array | pa.ChunkedArray, limit: int = SLICE) -> Iterator[tuple[int, Texts]]:
    """The texts of a column in slices of about ``limit`` bytes, each with its first row; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    a, n = 0, len(column)
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, side="right")) - 1)
        b = min(b, n)
        yield a, Texts(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        a = b


class Words:
    """start and end byte, 64-bit hash, and text number of each word, in order; ``first``: first word of each text, and the end."""

    def __init__(self, start, end, hash_, doc, first):
        self.start, self.end, self.hash, self.doc, self.first = start, end, hash_, doc, first


def _part_punctuation(data: np.ndarray, inside: np.ndarray) -> None:
    """Takes punctuation beyond ASCII out of words: that of Latin-1 but its letters, U+2000 to 206F and U+3000 to 303F."""
    at = np.flatnonzero(data[:-1] == 0xC2)
    at = at[~np.isin(data[at + 1], (0xAA, 0xB5, 0xBA))]
    inside[at] = inside[at + 1] = False
    for first, seconds in ((0xE2, (0x80, 0x81)), (0xE3, (0x80,))):
        at = np.flatnonzero(data[:-2] == first)
        at = at[np.isin(data[at + 1], seconds)]
        inside[at] = inside[at + 1] = inside[at + 2] = False


def words(texts: Texts, accept: np.ndarray = NON_SPACE, ascii_lower: bool = True) -> Words:
    data, n = texts.data, len(texts.data)
    inside = accept[data]
    if accept is ALNUM:
        _part_punctuation(data, inside)
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    cut = texts.offsets[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    begins[cut] |= inside[cut]
    ends[cut - 1] |= inside[cut - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    h = np.zeros(len(start), dtype=U)
    i = 0
    while i < len(start):
        base = start[i]
        j = max(i + 1, int(np.searchsorted(end, base + SEGMENT, side="right")))
        part = data[base : end[j - 1]]
        part = _ASCII_LOWER[part] if ascii_lower else part
        up, down = _power_tables(len(part))
        sums = np.zeros(len(part) + 1, dtype=U)
        np.cumsum((part.astype(U) + U(1)) * up[: len(part)], out=sums[1:])
        s, e = start[i:j] - base, end[i:j] - base
        h[i:j] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(U) * U(0xD6E8FEB86659FD93))
        i = j
    first = np.searchsorted(start, texts.offsets)
    first[-1] = len(start)
    doc = np.repeat(np.arange(len(texts)), np.diff(first))
    return Words(start, end, h, doc, first)


_STEP = [0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F]


def shingle_sets(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of ``size`` words of each text, ascending, and the bounds of each text's part.

    A text of fewer words has one shingle, its whole word sequence; a text without words has none.
    """
    counts = np.diff(w.first)
    made = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    bounds = np.zeros(len(made) + 1, dtype=np.int64)
    np.cumsum(made, out=bounds[1:])
    doc = np.repeat(np.arange(len(made)), made)
    at = np.arange(bounds[-1]) - bounds[doc] + w.first[doc]
    out = np.full(len(at), size, dtype=U)
    whole = counts[doc] >= size
    for k in range(size):
        step = U(_STEP[k % 5] + 2 * (k // 5))
        use = whole | (k < counts[doc])
        idx = np.where(use, at + k, 0)
        out += np.where(use, mix(w.hash[idx] ^ step) * step, U(0)) if len(w.hash) else U(0)
    out = mix(out + np.minimum(counts[doc], size).astype(U))
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        out[a:b].sort()
    keep = np.ones(len(out), dtype=bool)
    keep[1:] = (out[1:] != out[:-1]) | (doc[1:] != doc[:-1])
    sizes = np.bincount(doc[keep], minlength=len(made))
    np.cumsum(sizes, out=bounds[1:])
    return out[keep], bounds
