"""Banded alignment of whole leagues and of leagues in tiles, against a plain table of totals."""

import math
import random
import tracemalloc

import numpy as np
import pytest

from linkloom.operators import alignment

DAY = 86400


def plain(cost, width):
    """The path through a full table of totals, written out by its definition."""
    n, m = len(cost), len(cost[0])
    total = [[math.inf] * m for _ in range(n)]
    for i in range(n):
        for j in range(m):
            if abs(i - j) <= width:
                steps = [total[a][b] for a, b in ((i - 1, j - 1), (i - 1, j), (i, j - 1)) if a >= 0 and b >= 0]
                least = min(steps) if steps else 0
                total[i][j] = cost[i][j] + least
    path, i, j = [], n - 1, m - 1
    while i or j:
        path.append((i, j))
        if not i or not j:
            i, j = max(i - 1, 0), max(j - 1, 0)
            continue
        diagonal, up, left = total[i - 1][j - 1], total[i - 1][j], total[i][j - 1]
        if diagonal <= up and diagonal <= left:
            i, j = i - 1, j - 1
        elif up <= left:
            i -= 1
        else:
            j -= 1
    return [*path, (0, 0)][::-1]


def sequences(rng, n, m, coarse):
    """Times of both sides and name similarities; coarse ones have many ties."""
    s, t = (sorted(rng.randrange(20) * DAY if coarse else rng.randrange(20 * DAY) for _ in range(k)) for k in (n, m))
    name = [[rng.choice([0.0, 0.0, 0.5, 1.0]) if coarse else rng.choice([0.0, rng.random()]) for _ in range(m)] for _ in range(n)]
    return s, t, name


def matrix(s, t, name):
    s, t = np.asarray(s)[:, None] + np.zeros(len(t), dtype=np.int64), np.asarray(t)[None, :] + np.zeros((len(s), 1), dtype=np.int64)
    return alignment.costs(s, t, np.asarray(name)).tolist()


def test_whole_sequences():
    rng = random.Random(5)
    for _ in range(150):
        n, m = rng.randint(1, 25), rng.randint(1, 25)
        s, t, name = sequences(rng, n, m, rng.random() < 0.5)
        band = rng.choice([0.1, 0.3, 1.0])
        got = alignment.align(np.asarray(s), np.asarray(t), np.asarray(name), band)
        assert got == plain(matrix(s, t, name), alignment.band_width(n, m, band)), (n, m, band)
    assert alignment.align(np.zeros(0), np.zeros(3), np.zeros((0, 3))) == []


@pytest.mark.parametrize("tile", [4, 4096])
def test_leagues_in_tiles_have_the_path_of_the_whole_league(spark, tile):
    rng = random.Random(9)
    rows, want = [], set()
    shapes = [(17, 15), (10, 13), (1, 1), (1, 6), (20, 5), (13, 10), (11, 7), (3, 16)]
    for k, (n, m) in enumerate(shapes):
        s, t, name = sequences(rng, n, m, k % 2 == 0)
        for i in range(n):
            for j in range(m):
                if name[i][j] or i == 0 or j == 0:  # other pairs without a likeness are left out
                    rows.append((f"L{k}", f"s{i:02}", s[i], f"t{j:02}", t[j], name[i][j] or None))
        cost = matrix(s, t, name)
        want |= {(f"L{k}", f"s{i:02}", f"t{j:02}", round(cost[i][j] / alignment.UNIT, 6)) for i, j in plain(cost, alignment.band_width(n, m))}
    rows += rows[:40] + [("L0", None, 5, "t00", 5, 1.0), ("L9", "s", 5, None, None, 1.0)]
    rng.shuffle(rows)
    pairs = spark.createDataFrame(rows, "league_id string, s string, s_time bigint, t string, t_time bigint, name double")
    got = [(r["league_id"], r["s"], r["t"], round(r["cost"], 6)) for r in alignment.align_leagues(pairs, tile).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    if tile == 4:
        assert alignment.align_leagues(pairs.limit(0), tile).collect() == []


def test_a_tile_takes_bounded_memory():
    rng = np.random.default_rng(1)
    size = alignment.TILE
    s, t = (np.sort(rng.integers(0, 10**8, size)) for _ in range(2))
    empty = np.zeros(0, dtype=np.int64)
    far = np.full(size, alignment.FAR)
    tracemalloc.start()
    alignment.sweep(s, t, alignment.Names(empty, empty, np.zeros(0), 2 * size), 0, size, far, far, 0, steps=True)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 3 * size * size
