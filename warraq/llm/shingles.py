"""Sets of word shingles as sorted 64-bit hashes, many texts at a time."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

from warraq.llm.hashing import mixed, span_hashes

#: Words of a shingle, and bytes of text that are hashed at once.
WORDS, CHUNK = 5, 1 << 20
_WHITE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_FACTORS = mixed(np.arange(101, 101 + WORDS, dtype=np.uint64)) | np.uint64(1)


def _hashed(bodies: list[bytes], k: int) -> Iterator[np.ndarray]:
    units = np.frombuffer(b"\n".join(bodies) + b"\n", dtype=np.uint8)
    white = _WHITE[units]
    edge = np.diff(white.view(np.int8), prepend=1)
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if len(starts) and len(ends) and ends[0] < starts[0]:
        ends = ends[1:]
    words = span_hashes(units, starts, ends)
    first = np.searchsorted(starts, np.cumsum([0, *(len(b) + 1 for b in bodies)]))
    n = len(words)
    rolled = np.zeros(max(0, n - k + 1), dtype=np.uint64)
    for i in range(k if len(rolled) else 0):
        rolled += words[i : i + len(rolled)] * _FACTORS[i % WORDS]
    rolled = mixed(rolled)
    for a, b in zip(first, first[1:]):
        if b - a >= k:
            yield np.unique(rolled[a : b - k + 1])
        elif b > a:
            short = np.uint64(b - a)
            for i in range(a, b):
                short = short + words[i] * _FACTORS[i - a]
            yield mixed(np.array([short ^ np.uint64(0x5BD1E995)]))
        else:
            yield np.empty(0, dtype=np.uint64)


def shingle_sets(texts: Iterable[str], k: int = WORDS) -> Iterator[np.ndarray]:
    """The set of each text: distinct k-word shingles of its lower-cased (A-Z) words; of fewer words
    the whole sequence as one; of no words none."""
    with np.errstate(over="ignore"):
        held, n = [], 0
        for text in texts:
            held.append(text.encode().lower())
            n += len(held[-1])
            if n >= CHUNK:
                yield from _hashed(held, k)
                held, n = [], 0
        if held:
            yield from _hashed(held, k)
