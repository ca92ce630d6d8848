"""HyperMinHash sketches: per bucket the leading-zero count of the smallest hash and some mantissa bits.

A sketch has ``groups`` independent hash functions of ``buckets`` buckets each. A register holds 6 bits
of leading zeros and 10 bits of mantissa of the smallest rank in its bucket, so two sets agree in a
register about as often as their Jaccard similarity, plus a small chance of accidental agreement that
``estimate`` takes out again. Buckets that got no item borrow the next filled one, mixed with the distance.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from helixmill.functions.rolling import codes, mix, window_starts

RANK_BITS, MANTISSA_BITS = 40, 10
_U = np.uint64
_EMPTY = _U(2**64 - 1)


def registers(chars: np.ndarray, at: np.ndarray, k: int, groups: int, buckets: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """uint16 registers (strings x groups*buckets) of each string's k-character substrings, and which registers were filled.

    Strings shorter than k have no item; all their registers read 0 and unfilled.
    """
    n = len(at) - 1
    out = np.zeros((n, groups * buckets), np.uint16)
    filled = np.zeros((n, groups * buckets), bool)
    owner, place = window_starts(at, k)
    if not len(owner):
        return out, filled
    item = mix(codes(chars, k)[place])
    base = owner.astype(np.int64) * buckets
    for g in range(groups):
        with np.errstate(over="ignore"):
            h = mix(item, 1 + g + 1000 * seed)
        bucket = ((h >> _U(32)) * _U(buckets)) >> _U(32)
        rank = (h * _U(0xBF58476D1CE4E5B9)) >> _U(64 - RANK_BITS)
        least = np.full(n * buckets, _EMPTY)
        np.minimum.at(least, base + bucket.astype(np.int64), rank)
        least = least.reshape(n, buckets)
        have = least != _EMPTY
        filled[:, g * buckets : (g + 1) * buckets] = have
        out[:, g * buckets : (g + 1) * buckets] = _borrow(_compress(np.where(have, least, 0)), have)
    return out, filled


def _compress(rank: np.ndarray) -> np.ndarray:
    bits = np.frexp(rank.astype(np.float64))[1].astype(np.int64)  # exact: ranks have 40 bits
    zeros = (RANK_BITS - bits).clip(0, 63).astype(_U)
    mantissa = ((rank << zeros) >> _U(RANK_BITS - 1 - MANTISSA_BITS)) & _U((1 << MANTISSA_BITS) - 1)
    return ((zeros << _U(MANTISSA_BITS)) | mantissa).astype(np.uint16)


def _borrow(reg: np.ndarray, have: np.ndarray) -> np.ndarray:
    """Empty buckets take the next filled one to the right, around the end, changed by the distance."""
    n, b = reg.shape
    if have.all():
        return reg
    twice = np.concatenate([have, have], axis=1)
    nearest = np.where(twice, np.arange(2 * b), 4 * b)
    nearest = np.minimum.accumulate(nearest[:, ::-1], axis=1)[:, ::-1][:, :b]
    lost = nearest >= 4 * b
    away = np.where(lost, 0, nearest - np.arange(b))
    taken = np.take_along_axis(reg, np.where(lost, 0, nearest % b), axis=1)
    with np.errstate(over="ignore"):
        return np.where(lost, 0, (taken.astype(np.uint32) * np.uint32(1) + away.astype(np.uint32) * np.uint32(40503)) & 0xFFFF).astype(np.uint16)


def band_keys(reg: np.ndarray, bands: int, rows: int, seed: int = 0) -> np.ndarray:
    """64-bit key of each band of ``rows`` registers (strings x bands); a band's registers lie ``bands`` apart."""
    key = np.zeros((reg.shape[0], bands), _U)
    with np.errstate(over="ignore"):
        for r in range(rows):
            key = mix(key ^ reg[:, r * bands : (r + 1) * bands].astype(_U), 7 + r)
        return mix(key + np.arange(bands, dtype=_U) * _U(0x9E3779B97F4A7C15), 77 + seed)


@lru_cache(4096)
def accidental(n: int, m: int) -> float:
    """Chance that a register of two disjoint sets with n and m items in the bucket agrees."""
    i = np.arange(RANK_BITS)[:, None]
    lo = 2.0 ** -(i + 1) * (1 + np.arange(1 << MANTISSA_BITS)[None, :] / (1 << MANTISSA_BITS))
    hi = lo + 2.0 ** -(i + 1 + MANTISSA_BITS)
    cell = lambda x: (1 - lo) ** x - (1 - np.minimum(hi, 1)) ** x
    return float((cell(n) * cell(m)).sum())


def estimate(a: np.ndarray, b: np.ndarray, fa: np.ndarray, fb: np.ndarray, na: np.ndarray, nb: np.ndarray, buckets: int) -> np.ndarray:
    """Jaccard estimates of row pairs, corrected for accidental agreement of registers."""
    used = fa | fb
    total = used.sum(axis=1)
    equal = ((a == b) & fa & fb).sum(axis=1)
    per = lambda x: np.maximum(1, np.round(x / buckets)).astype(int)
    kinds, which = np.unique(per(na) << 32 | per(nb), return_inverse=True)
    chance = np.array([accidental(int(x >> 32), int(x & 0xFFFFFFFF)) for x in kinds])[which] * total
    return np.where(total > 0, (equal - chance) / np.maximum(total - chance, 1e-9), 0.0).clip(0, 1)
