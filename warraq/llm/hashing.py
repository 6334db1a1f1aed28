"""64-bit hashes of many spans of a text at once, and minimum-hash signatures."""

from __future__ import annotations

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
_powers: dict[int, np.ndarray] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2**64, kept for the next call."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        have[0] = 1
        _powers[int(base)] = have = np.multiply.accumulate(have)
    return have[:n]


_units = mixed(np.arange(1, 1 << 16, dtype=np.uint64))


def span_hashes(units: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of units[start:end] for each span: equal spans have equal hashes wherever they stand."""
    values = _units[units] if units.dtype == np.uint8 else mixed(units.astype(np.uint64) + np.uint64(1))
    total = np.zeros(len(units) + 1, dtype=np.uint64)
    np.cumsum(values * powers(BASE, len(units)), out=total[1:])
    span = (total[ends] - total[starts]) * powers(INVERSE, len(units) + 1)[starts]
    return mixed(span + (ends - starts).astype(np.uint64))


def signature_seeds(k: int) -> tuple[np.ndarray, np.ndarray]:
    a, b = mixed(np.arange(1, 2 * k + 1, dtype=np.uint64)).reshape(2, k)
    return a | np.uint64(1), b


def signature(hashes: np.ndarray, seeds: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The minimum of each of k hash functions over the set, as 16 bits each."""
    a, b = seeds
    least = None
    for i in range(0, len(hashes), 16384):
        part = (hashes[i : i + 16384, None] * a + b).min(axis=0)
        least = part if least is None else np.minimum(least, part)
    return (mixed(least) & np.uint64(0xFFFF)).astype(np.uint16)
