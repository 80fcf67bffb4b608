"""Vectorised words: byte classes cut texts into words, and every word gets a 64-bit hash.

The hash of a word is a polynomial over randomised byte values modulo 2^64, finished by a
mixer; sequences of words are hashed as Rabin-Karp polynomials over the word hashes.
"""

from __future__ import annotations

import numpy as np

_RNG = np.random.default_rng(20240607)
_BYTE_VALUE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
#: Odd, so that it has an inverse modulo 2^64.
ROLL = np.uint64(0xD1342543DE82EF95)
ROLL_INVERSE = np.uint64(pow(int(ROLL), -1, 2**64))

#: True for bytes that separate words: space and the controls 09 to 0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: True for ASCII bytes other than digits and lower-case letters.
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[0x30:0x3A] = NOT_ALNUM[0x61:0x7B] = NOT_ALNUM[0x80:] = False
#: Lower-cases A to Z only.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_BLOCK = 8 << 20


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finisher."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64."""
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out, dtype=np.uint64) if n else out


def split_words(data: np.ndarray, at: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (byte positions) of all words, and the n + 1 word offsets of the rows."""
    inside = ~separator[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    rows = np.flatnonzero(at[1:] > at[:-1])
    heads, tails = at[:-1][rows], at[1:][rows] - 1
    first[heads] = inside[heads]
    last[tails] = inside[tails]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, at)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the (non-empty) byte spans."""
    out = np.empty(len(starts), np.uint64)
    size = np.cumsum(ends - starts)
    begin = 0
    while begin < len(starts):  # in blocks, so that very long rows need no more memory
        base = size[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(size, base + _BLOCK, side="right")))
        long = ends[begin:end] - starts[begin:end]
        head = np.cumsum(long) - long
        place = np.arange(int(long.sum())) - np.repeat(head, long)
        value = _BYTE_VALUE[data[place + np.repeat(starts[begin:end], long)]]
        value *= powers(_BASE, int(long.max()))[place]
        out[begin:end] = mix(np.add.reduceat(value, head) + long.astype(np.uint64))
        begin = end
    return out


def hash_words(data: np.ndarray, at: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and the n + 1 word offsets of the rows."""
    if not len(data):
        return np.empty(0, np.uint64), np.zeros(len(at), np.int64)
    starts, ends, rows = split_words(data, at, separator)
    return hash_spans(data, starts, ends), rows


def roll(words: np.ndarray, width: int) -> np.ndarray:
    """Rabin-Karp hashes of every run of ``width`` consecutive entries, rows not regarded."""
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    prefix = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * powers(ROLL_INVERSE, len(words)), out=prefix[1:])
    return mix((prefix[width:] - prefix[:-width]) * powers(ROLL, n))


def runs_in_rows(rows: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the runs of ``width`` words that lie inside one row, and their row numbers."""
    count = np.maximum(np.diff(rows) - width + 1, 0)
    row = np.repeat(np.arange(len(count)), count)
    inner = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    return inner + rows[:-1][row], row


def run_bounds(ordered: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal values in a sorted array."""
    if not len(ordered):
        return np.empty(0, np.int64)
    return np.concatenate(([0], np.flatnonzero(ordered[1:] != ordered[:-1]) + 1))
