"""Golomb-Rice coded sorted sets of integers: gaps as unary quotients and fixed-width remainders."""

from __future__ import annotations

import numpy as np


def encode(values: np.ndarray, span: int) -> tuple[int, bytes, bytes]:
    """Code strictly increasing ``values`` from [0, span): the Rice parameter, quotients, remainders."""
    n = len(values)
    if not n:
        return 0, b"", b""
    k = max(0, int(np.log2(max(span // n, 1))))
    gap = np.diff(values, prepend=0).astype(np.int64)
    stops = np.cumsum((gap >> k) + 1) - 1
    unary = np.ones(int(stops[-1]) + 1, np.uint8)
    unary[stops] = 0
    rest = ((gap[:, None] >> np.arange(k)) & 1).astype(np.uint8)
    return k, np.packbits(unary).tobytes(), np.packbits(rest).tobytes()


def decode(n: int, k: int, quotients: bytes, remainders: bytes) -> np.ndarray:
    """The ``n`` values that ``encode`` coded."""
    if not n:
        return np.empty(0, np.int64)
    stops = np.flatnonzero(np.unpackbits(np.frombuffer(quotients, np.uint8)) == 0)[:n]
    gap = (np.diff(stops, prepend=-1) - 1).astype(np.int64) << k
    if k:
        rest = np.unpackbits(np.frombuffer(remainders, np.uint8), count=n * k).reshape(n, k)
        gap += rest.astype(np.int64) @ (np.int64(1) << np.arange(k, dtype=np.int64))
    return np.cumsum(gap)
