"""Vectorised rolling codes of the windows of many strings at once. Pure numpy, no Spark."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (two multiply-xorshift rounds)."""
    x = x + _U((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(29))) * _U(0xA0761D6478BD642F | 1)
    return x ^ (x >> _U(32))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Characters of a string column in one array, and the offset of each string; null reads as empty.

    Pure ASCII stays one byte per character; anything else becomes code points, so that positions
    count characters in either case.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    at = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    data, at = data[at[0] : at[-1]], at - at[0]
    if not len(data) or data.max() < 128:
        return data, at
    begins = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32), begins[at]


def window_starts(at: np.ndarray, k: int, step: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """For every window of k characters inside one string: the string's number and the window's place in the flat array."""
    n = np.maximum((np.diff(at) - k) // step + 1, 0)
    n[np.diff(at) < k] = 0
    owner = np.repeat(np.arange(len(n)), n)
    first = np.cumsum(n) - n
    return owner, at[:-1][owner] + (np.arange(len(owner)) - first[owner]) * step


def codes(chars: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """A 64-bit code of the k characters that begin at each place (equal text, equal code).

    Built by doubling: the code of a+b characters is code(a) * B^b + code(b) further on, so it takes
    O(log k) passes over the array.
    """
    n = len(chars) - k + 1
    if n <= 0:
        return np.zeros(0, _U)
    base = _BASE + _U(2 * seed)
    one = mix(np.arange(256, dtype=_U), seed + 1)[chars] if chars.dtype == np.uint8 else mix(chars.astype(_U), seed + 1)
    power, part, size = base, one, 1
    done, have = None, 0
    with np.errstate(over="ignore"):
        rest = k
        while rest:
            if rest & 1:
                if done is None:
                    done, have = part, size
                else:
                    m = len(chars) - have - size + 1
                    done = done[:m] * power + part[have : have + m]
                    have += size
            rest >>= 1
            if rest:
                m = len(part) - size
                part = part[:m] * power + part[size : size + m]
                power, size = power * power, size * 2
    return done[:n]
