"""Hashed word shingles of a batch of texts, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_U = np.uint64
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(0, 2**64, 256, dtype=np.uint64, endpoint=False)
_BYTE[_SPACE] = 0
_STEP = np.multiply.accumulate(np.concatenate((np.ones(1, dtype=np.uint64), np.full(65_535, 0xD1342543DE82EF95, dtype=np.uint64))))
_ODD = _rng.integers(0, 2**63, 64, dtype=np.uint64) * _U(2) + _U(1)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    x = x + _U((seed + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hash of every word of the texts (A-Z lower-cased, ASCII white space), and where each text's words begin."""
    raw = [t.encode("utf-8", "surrogatepass").lower() for t in texts]  # bytes.lower() touches A-Z only
    data = np.frombuffer(b" ".join(raw) + b" ", dtype=np.uint8)
    inside = ~_SPACE[data]
    before = np.concatenate(([False], inside[:-1]))
    starts = np.flatnonzero(inside & ~before)
    ends = np.cumsum([len(r) + 1 for r in raw])
    bounds = np.searchsorted(starts, np.concatenate(([0], ends)))
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), bounds
    at = np.arange(len(data)) - np.repeat(starts, np.diff(np.append(starts, len(data)))) if starts[0] == 0 else None
    if at is None:
        at = np.arange(len(data)) - np.concatenate((np.zeros(starts[0], dtype=np.int64), np.repeat(starts, np.diff(np.append(starts, len(data))))))
    return mix(np.add.reduceat(_BYTE[data] * _STEP[at & 0xFFFF], starts)), bounds


def shingle_sets(texts: list[str], k: int) -> list[np.ndarray]:
    """The sorted distinct k-word shingle hashes of each text; with fewer words, the whole sequence is one shingle."""
    words, bounds = word_hashes(texts)
    n = len(words)
    if n >= k:
        grams = np.zeros(n - k + 1, dtype=np.uint64)
        for j in range(k):
            grams += words[j : n - k + 1 + j] * _ODD[j]
        grams = mix(grams, k)
    out = []
    for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if e - s >= k:
            out.append(np.unique(grams[s : e - k + 1]))
        elif e > s:
            out.append(mix(np.asarray([np.bitwise_xor.reduce(mix(words[s:e] * _ODD[: e - s], 40))], dtype=np.uint64), 50 + e - s))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def sliced(texts: list[str], most: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Bounds of consecutive slices of at most ``most`` code points (or one text)."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)
