"""One-permutation MinHash with optimal densification, and band keys."""

from __future__ import annotations

import math

import numpy as np

from .text import U, mix


def banding(num: int, den: int, miss: float = 1e-6) -> tuple[int, int]:
    """(rows in a band, bands): a pair whose likeness is num/den shares no band with probability below ``miss``."""
    s = num / den
    rows = max(1, round(math.log(0.27) / math.log(s))) if s < 1 else 8
    rows = min(rows, 10)
    return rows, max(1, math.ceil(math.log(miss) / math.log1p(-(s**rows)))) if s < 1 else 1


def signatures(sets: np.ndarray, bounds: np.ndarray, bins: int) -> np.ndarray:
    """One row of ``bins`` values for each set that isn't empty (rows of empty sets are left 0).

    Each element falls into one bin by its high bits; a bin keeps its least element. An empty bin takes the value of
    the first bin with elements in a pseudo-random sequence that depends on the bin alone.
    """
    n = len(bounds) - 1
    doc = np.repeat(np.arange(n), np.diff(bounds))
    place = ((sets >> U(32)) * U(bins)) >> U(32)
    slot = doc * bins + place.astype(np.int64)
    lead = np.ones(len(slot), dtype=bool)
    lead[1:] = slot[1:] != slot[:-1]
    sig = np.zeros(n * bins, dtype=U)
    full = np.zeros(n * bins, dtype=bool)
    sig[slot[lead]], full[slot[lead]] = sets[lead], True
    sig, full = sig.reshape(n, bins), full.reshape(n, bins)
    out = sig.copy()
    rows, cols = np.nonzero(~full & (np.diff(bounds) > 0)[:, None])
    attempt = 0
    while len(rows):
        attempt += 1
        other = (mix(cols.astype(U) * U(0x9E3779B97F4A7C15) + U(attempt * 0xC2B2AE3D27D4EB4F % (1 << 64))) % U(bins)).astype(np.int64)
        hit = full[rows, other]
        out[rows[hit], cols[hit]] = sig[rows[hit], other[hit]]
        rows, cols = rows[~hit], cols[~hit]
    return out


def band_keys(sig: np.ndarray, rows: int, bands: int) -> np.ndarray:
    """A 64-bit key of each band; keys of different bands differ."""
    n = len(sig)
    weights = mix(np.arange(1, rows + 1, dtype=U)) | U(1)
    keys = (mix(sig.reshape(n, bands, rows)) * weights).sum(axis=2, dtype=U)
    return mix(keys + mix(np.arange(1, bands + 1, dtype=U) * U(0xD1B54A32D192ED03))).view(np.int64)
