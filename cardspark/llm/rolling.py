"""Rolling hashes of bytes, for the operators that look at text in numpy."""

from __future__ import annotations

import functools

import numpy as np

_M = 0x9E3779B97F4A7C15 | 1


@functools.lru_cache(1)
def _values() -> np.ndarray:
    return np.random.default_rng(17).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)


_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """M**i and M**-i modulo 2**64 for i up to n."""
    if not _powers or len(_powers[0]) <= n:
        size = 1 << max(16, n.bit_length())
        both = []
        for m in (_M, pow(_M, -1, 1 << 64)):
            p = np.full(size, np.uint64(m))
            p[0] = 1
            both.append(np.cumprod(p, dtype=np.uint64))
        _powers[:] = both
    return _powers[0], _powers[1]


def mixed(x: np.ndarray) -> np.ndarray:
    """Well-spread bits of 64-bit words."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums from which the hash of any slice of the bytes follows."""
    p, _ = powers(len(data))
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_values()[data] * p[: len(data)], out=out[1:])
    return out


def slice_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of bytes start..end of each slice; equal slices have equal hashes wherever they stand."""
    _, inverse = powers(len(sums))
    return mixed((sums[end] - sums[start]) * inverse[start])


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of each text, A-Z in lower case, and where each text's words begin and end."""
    raw = [(t or "").encode() + b" " for t in texts]
    b = np.frombuffer(b"".join(raw), np.uint8)
    b = b + ((b >= 65) & (b <= 90)).astype(np.uint8) * np.uint8(32)
    space = (b == 32) | ((b >= 9) & (b <= 13))
    edge = np.diff(np.concatenate([[True], space]).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    h = slice_hashes(prefix_sums(b), start, end)
    return h, np.concatenate([[0], np.searchsorted(start, np.cumsum([len(r) for r in raw]))]).astype(np.int64)
