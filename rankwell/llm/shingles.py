"""Sets of word shingles as sorted 64-bit hashes."""

from __future__ import annotations

import numpy as np

WORDS = 5
_FACTOR = 0x9E3779B97F4A7C15  # odd, so that its powers have inverses modulo 2**64
_INVERSE = pow(_FACTOR, -1, 1 << 64)
_BYTE_CODES = np.random.default_rng(2).integers(1, 1 << 63, 256, dtype=np.uint64)
_TABLES: dict[str, np.ndarray] = {}
_KEPT = 1 << 23  # powers that a worker keeps; longer tables go with the texts they were made for


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; short tables are kept for the next call."""
    known = _TABLES.get(str(base), np.ones(1, np.uint64))
    while len(known) < n:
        known = np.concatenate([known, known * np.uint64(pow(base, len(known), 1 << 64))])
    if len(known) <= _KEPT:
        _TABLES[str(base)] = known
    return known[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str | None], words: int = WORDS) -> list[np.ndarray]:
    """For every text the sorted distinct hashes of its runs of ``words`` words, A-Z lower-cased.

    Words stand between spaces and the ASCII controls 9 to 13. A text with fewer words has one run, all of them; one
    without words has none. Hashes are taken over the bytes of a run with single spaces, from sums over all texts.
    """
    split = [(text or "").encode("utf-8", "surrogatepass").lower().split() for text in texts]
    counts = np.array([len(s) for s in split], dtype=np.int64)
    data = np.frombuffer(b" ".join([w for s in split for w in s]) + b" ", np.uint8)
    if not counts.sum():
        return [np.zeros(0, np.uint64) for _ in texts]
    ends = np.flatnonzero(data == 32)
    starts = np.r_[0, ends[:-1] + 1]
    sums = np.cumsum(_BYTE_CODES[data] * _powers(_FACTOR, len(data)))
    sums = np.r_[np.uint64(0), sums]
    inverse = _powers(_INVERSE, len(data))
    out = []
    for begin, n in zip(np.cumsum(counts) - counts, counts, strict=True):
        if not n:
            out.append(np.zeros(0, np.uint64))
            continue
        width = min(words, n)
        a, b = starts[begin : begin + n - width + 1], ends[begin + width - 1 : begin + n]
        hashes = mix((sums[b] - sums[a]) * inverse[a])
        hashes.sort()
        out.append(hashes[np.r_[True, hashes[1:] != hashes[:-1]]])
    return out
