"""Jaro similarity of whole columns of names, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Cells of a comparison matrix that are held at a time.
CELLS = 1 << 21


def characters(names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of the names, one row each, filled up with zeros, and their lengths."""
    lengths = np.fromiter(map(len, names), dtype=np.int64, count=len(names))
    width = max(int(lengths.max(initial=0)), 1)
    flat = np.frombuffer("".join(names).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    out = np.zeros((len(names), width), dtype=np.uint32)
    out[np.arange(width) < lengths[:, None]] = flat
    return out, lengths


def _slices(size: np.ndarray) -> Iterator[np.ndarray]:
    """Rows of like size together, as many as CELLS allows."""
    order = np.argsort(size, kind="stable")
    begin = 0
    while begin < len(order):
        end = begin + 1
        step = max(1, CELLS // max(int(size[order[begin]]), 1))
        end = min(len(order), begin + step)
        while end - begin > 1 and int(size[order[end - 1]]) * (end - begin) > 2 * CELLS:
            end = begin + (end - begin + 1) // 2
        yield order[begin:end]
        begin = end


def _jaro_rows(a: np.ndarray, la: np.ndarray, b: np.ndarray, lb: np.ndarray, whole: bool) -> np.ndarray:
    """Jaro similarity of row i of ``a`` with row i of ``b``; no row is empty."""
    reach = np.maximum(np.maximum(la, lb) // 2 - 1, 0)[:, None]
    at, rows = np.arange(b.shape[1]), np.arange(len(a))
    free = at < lb[:, None]
    hit = np.zeros(a.shape, dtype=bool)
    for i in range(a.shape[1]):
        fits = (b == a[:, i, None]) & free & (np.abs(at - i) <= reach) & (i < la)[:, None]
        first = fits.argmax(axis=1)
        hit[:, i] = fits[rows, first]
        free[rows[hit[:, i]], first[hit[:, i]]] = False
    taken = ~free & (at < lb[:, None])
    m = hit.sum(axis=1).astype(np.float64)
    most = min(a.shape[1], b.shape[1])
    left = np.take_along_axis(a, np.argsort(~hit, axis=1, kind="stable"), axis=1)[:, :most]
    right = np.take_along_axis(b, np.argsort(~taken, axis=1, kind="stable"), axis=1)[:, :most]
    moved = ((left != right) & (np.arange(most) < m[:, None])).sum(axis=1)
    half = moved // 2 if whole else moved / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(m > 0, (m / la + m / lb + (m - half) / m) / 3.0, 0.0)


def jaro(a: list[str], b: list[str], whole: bool = False) -> np.ndarray:
    """The Jaro similarity of each pair; an odd character out of place counts half a transposition, or none if ``whole``."""
    out = np.fromiter((float(x == y) for x, y in zip(a, b, strict=True)), dtype=np.float64, count=len(a))
    open_ = [i for i, (x, y) in enumerate(zip(a, b, strict=True)) if x and y and x != y]
    if open_:
        (ca, la), (cb, lb) = characters([a[i] for i in open_]), characters([b[i] for i in open_])
        open_ = np.array(open_)
        for part in _slices(np.maximum(la, lb)):
            wide_a, wide_b = int(la[part].max()), int(lb[part].max())
            out[open_[part]] = _jaro_rows(ca[part, :wide_a], la[part], cb[part, :wide_b], lb[part], whole)
    return out


def winkler(a: list[str], b: list[str], whole: bool = False) -> np.ndarray:
    """Jaro raised by 0.1 a shared leading character, up to four."""
    j = jaro(a, b, whole)
    prefix = np.zeros(len(a), dtype=np.int64)
    for k in range(4):
        same = np.fromiter((x[k : k + 1] == y[k : k + 1] != "" for x, y in zip(a, b, strict=True)), dtype=bool, count=len(a))
        prefix += same & (prefix == k)
    return j + prefix * 0.1 * (1.0 - j)


def most_winkler(a: np.ndarray, la: np.ndarray, b: np.ndarray, lb: np.ndarray) -> np.ndarray:
    """An upper bound of the Jaro-Winkler similarity of every name of one side with every name of the other.

    Jaro similarity is at most that of names whose common characters are all in reach and in order; the characters that
    two names have in common are counted by character. Both sides are as :func:`characters` returns them.
    """
    common = np.zeros((len(a), len(b)), dtype=np.int32)
    for ch in np.intersect1d(a, b).tolist():
        if ch:
            common += np.minimum((a == ch).sum(axis=1)[:, None], (b == ch).sum(axis=1)[None, :]).astype(np.int32)
    with np.errstate(divide="ignore", invalid="ignore"):
        j = np.where(common > 0, (common / la[:, None] + common / lb[None, :] + 1) / 3, 0.0)
    j = np.where((la[:, None] == 0) & (lb[None, :] == 0), 1.0, np.minimum(j, 1.0))
    prefix = np.zeros(j.shape)
    for k in range(min(4, a.shape[1], b.shape[1])):
        prefix += (a[:, k, None] == b[None, :, k]) & (a[:, k, None] != 0) & (prefix == k)
    return j + prefix * 0.1 * (1 - j)
