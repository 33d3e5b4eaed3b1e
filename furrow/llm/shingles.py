"""Word shingles of Arrow text columns as 64-bit hashes, with numpy only: no Python object per word.

A word's hash is a polynomial over random 64-bit values of its bytes, modulo 2**64; A-Z have the
values of a-z. A shingle's hash mixes the hashes of its words in order. Equal shingles have equal
hashes; different ones differ but for a chance of about 2**-64 a pair.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from furrow.llm.common import text_bytes, text_offsets, text_slices

_RANDOM = np.random.Generator(np.random.PCG64(20240229))
_VALUE = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_VALUE[ord("A") : ord("Z") + 1] = _VALUE[ord("a") : ord("z") + 1]
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_PLACE = _RANDOM.integers(1, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit values whose output bits depend on all input bits."""
    x = x + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of the base and of its inverse, 0 to n - 1."""
    global _powers
    if len(_powers[0]) < n:
        inverse = pow(_BASE, -1, 2**64)
        both = []
        for b in (_BASE, inverse):
            x = np.full(max(n, 1 << 20), b, dtype=np.uint64)
            x[0] = 1
            both.append(np.cumprod(x, dtype=np.uint64))
        _powers = (both[0], both[1])
    return _powers


def word_hashes(data: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, its first byte's place) in data; breaks: where texts begin, ascending."""
    n = len(data)
    if not n:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    breaks = breaks[breaks < n]
    space = _SPACE[data]
    edge = np.empty(n + 1, dtype=bool)
    edge[0] = edge[n] = True
    edge[1:n] = space[:-1]
    edge[breaks] = True
    starts = np.flatnonzero(edge[:n] & ~space)
    after = np.ones(n, dtype=bool)
    after[:-1] = space[1:]
    after[breaks[breaks > 0] - 1] = True
    ends = np.flatnonzero(after & ~space)
    power, inverse = _power(n)
    sums = np.cumsum(_VALUE[data] * power[:n], dtype=np.uint64)
    below = np.where(starts > 0, sums[starts - 1], np.uint64(0))
    return mix((sums[ends] - below) * inverse[starts] + (ends - starts).astype(np.uint64)), starts


def _long(data: np.ndarray, most: int = 1 << 21) -> np.ndarray:
    """Word hashes of one text of any length, piece by piece, cut at spaces."""
    out, at = [], 0
    while at < len(data):
        to = min(len(data), at + most)
        while to < len(data):
            gap = np.flatnonzero(_SPACE[data[at:to]])
            if len(gap) and gap[-1] > 0:
                to = at + int(gap[-1])
                break
            to = min(len(data), to + most)  # a word longer than the piece
        out.append(word_hashes(data[at:to], np.zeros(1, np.int64))[0])
        at = to
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def shingle_sets(column: pa.Array, width: int = 5):
    """Yield (row, sorted distinct shingle hashes) for each row of a text column without nulls.

    A text with fewer words than width has its whole sequence as one shingle; without words, none.
    """
    data, offsets = text_bytes(column), text_offsets(column)
    for first, last in text_slices(column):
        lo, hi = offsets[first], offsets[last]
        if last == first + 1:
            words = _long(data[lo:hi])
            bounds = np.array([0, len(words)])
        else:
            words, starts = word_hashes(data[lo:hi], offsets[first:last] - lo)
            bounds = np.append(np.searchsorted(starts, offsets[first:last] - lo), len(words))
        n = len(words) - width + 1
        if n > 0:
            shingles = np.zeros(n, np.uint64)
            for k in range(width):
                shingles += words[k : k + n] * _PLACE[k]
            shingles = mix(shingles, 1)
        for i in range(last - first):
            a, b = int(bounds[i]), int(bounds[i + 1])
            if b - a >= width:
                yield first + i, _distinct(shingles[a : b - width + 1])
            elif b > a:
                short = (words[a:b] * _PLACE[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
                yield first + i, mix(np.array([short], np.uint64), 2)
            else:
                yield first + i, np.empty(0, np.uint64)


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])]


def set_name(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits for a set, whatever its order."""
    return int(mix(shingles, 3).sum(dtype=np.uint64)), int(mix(shingles, 4).sum(dtype=np.uint64))
