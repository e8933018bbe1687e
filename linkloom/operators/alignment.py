"""Monotone alignment of the source and target events of leagues of any size, inside a Sakoe-Chiba band.

The matrix of a league is cut into square tiles of events. A tile needs the totals along its upper and left edge and hands
on those along its lower and right edge, so all tiles of an antidiagonal, of all leagues, run at once, each in a task of its
own that holds one tile. Going back, each league's path runs through one tile after the other, which is computed again
from its stored edges. Costs are whole billionths, so totals are exact and the path is that of the whole matrix,
whatever the size of the tiles. (A cut at unique anchors would not be: the cheapest path need not pass through one.)
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut

#: Events on a side of a tile; a task holds a byte for each of its cells.
TILE = 4096
BAND = 0.3
DAY = 86400
#: Costs are multiples of one in so many; FAR is the total of what cannot be reached.
UNIT, FAR = 10**9, 1 << 60
DIAGONAL, UP, LEFT = 0, 1, 2
_EDGES = "league_id string, bi bigint, bj bigint, kind string, data binary"
_STEPS = "league_id string, i bigint, j bigint, on_path boolean"
_TILE = ["league_id", "bi", "bj"]


def band_width(n: int, m: int, band: float = BAND) -> int:
    return max(1, int(np.ceil(max(n, m) * band)))


def costs(s_time: np.ndarray, t_time: np.ndarray, name: np.ndarray) -> np.ndarray:
    """1 - (name + nearness in time) / 2 in whole parts of UNIT."""
    apart = (s_time - t_time).astype(np.float64)
    return np.rint(UNIT * (1.0 - (name + np.exp(-(apart * apart) / (2.0 * DAY * DAY))) / 2.0)).astype(np.int64)


class Names:
    """Name similarities of the cells of a tile, by antidiagonal; a cell that is not listed has 0."""

    def __init__(self, i: np.ndarray, j: np.ndarray, value: np.ndarray, diagonals: int):
        order = np.argsort(i + j, kind="stable")
        self.i, self.value = i[order], value[order]
        self.cuts = np.searchsorted((i + j)[order], np.arange(diagonals + 1))

    def on(self, d: int, low: int, high: int) -> np.ndarray:
        """The similarities of cells (low, d - low) to (high, d - high)."""
        span = slice(self.cuts[d], self.cuts[d + 1])
        i, value = self.i[span], self.value[span]
        inside = (i >= low) & (i <= high)
        out = np.zeros(high - low + 1)
        out[i[inside] - low] = value[inside]
        return out


def sweep(s_time: np.ndarray, t_time: np.ndarray, names: Names, shift: int, width: int, top: np.ndarray, left: np.ndarray, corner: int, steps: bool = False):
    """(totals along the lower edge, along the right edge, the step back from each cell or None) of one tile.

    ``shift`` is the tile's first row less its first column; ``top`` and ``left`` are the totals before its first row and
    column, ``corner`` the one before both. Of equally cheap steps back the diagonal one is taken, then the one up.
    """
    h, w = len(s_time), len(t_time)
    bottom, right = np.full(w, FAR), np.full(h, FAR)
    back = np.full((h, w), DIAGONAL, dtype=np.int8) if steps else None
    # an antidiagonal holds the total of row i at i + 1, that of the row above the tile at 0
    before, last = np.full(h + 2, FAR), np.full(h + 2, FAR)
    before[0], last[0], last[1] = corner, top[0], left[0]
    for d in range(h + w - 1):
        now = np.full(h + 2, FAR)
        low = max(0, d - w + 1, -((width + shift - d) // 2))
        high = min(h - 1, d, (d - shift + width) // 2)
        if low <= high:
            diagonal, up, beside = before[low : high + 1], last[low : high + 1], last[low + 1 : high + 2]
            least = np.minimum(np.minimum(diagonal, up), beside)
            cost = costs(s_time[low : high + 1], t_time[d - high : d - low + 1][::-1], names.on(d, low, high))
            now[low + 1 : high + 2] = np.where(least < FAR, least + cost, FAR)
            if steps:
                i = np.arange(low, high + 1)
                back[i, d - i] = np.where(diagonal == least, DIAGONAL, np.where(up == least, UP, LEFT))
            if high == h - 1:
                bottom[d - high] = now[high + 1]
            if d - low == w - 1:
                right[low] = now[low + 1]
        if d + 1 < w:
            now[0] = top[d + 1]
        if d + 1 < h:
            now[d + 2] = left[d + 1]
        before, last = last, now
    return bottom, right, back


def walk(back: np.ndarray, i: int, j: int) -> tuple[list[tuple[int, int]], int, int]:
    """(the cells of the path back from a cell, the cell outside the tile that it leaves to)."""
    path = []
    while i >= 0 and j >= 0:
        path.append((i, j))
        step = back[i, j]
        i, j = i - (step != LEFT), j - (step != UP)
    return path, i, j


def align(s_time: np.ndarray, t_time: np.ndarray, name: np.ndarray, band: float = BAND) -> list[tuple[int, int]]:
    """The path of two sequences held whole, ``name`` being the full matrix of name similarities."""
    n, m = name.shape
    if not n or not m:
        return []
    width = band_width(n, m, band)
    if abs(n - m) > width + 1:
        return _outside(n, m)
    i, j = np.indices(name.shape).reshape(2, -1)
    far = lambda k: np.full(k, FAR)
    *_, back = sweep(s_time, t_time, Names(i, j, name.ravel(), n + m), 0, width, far(m), far(n), 0, steps=True)
    end = (n - 1 - (n - m > width), m - 1 - (m - n > width))
    path, *_ = walk(back, *end)
    return path[::-1] + ([(n - 1, m - 1)] if end != (n - 1, m - 1) else [])


def _outside(n: int, m: int) -> list[tuple[int, int]]:
    """The path where the last cell is out of the band's reach: straight along the edge, then diagonally."""
    long = max(n, m) - min(n, m)
    edge = [(k, 0) if n > m else (0, k) for k in range(long)]
    return edge + [(k + max(n - m, 0), k + max(m - n, 0)) for k in range(min(n, m))]


# --- leagues -----------------------------------------------------------------------------------------------------------


def _numbered(pairs: DataFrame, side: str, name: str) -> DataFrame:
    """(league_id, id, time, number): each event once, at its earliest time, numbered from 0 by (time, id).

    Days are counted first, so no task orders more than a day of a league.
    """
    time = F.coalesce(F.min(f"{side}_time"), F.lit(0)).cast("long")
    rows = pairs.groupBy("league_id", F.col(side).alias("id")).agg(time.alias("time")).withColumn("_day", F.floor(F.col("time") / DAY))
    days = rows.groupBy("league_id", "_day").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy("league_id").orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    days = days.select("league_id", "_day", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("league_id", "_day").orderBy("time", "id")) - 1
    return cut(rows.join(days, ["league_id", "_day"]).select("league_id", F.col("id"), "time", (F.col("_before") + within).cast("long").alias(name)))


def _pack(*arrays: np.ndarray) -> bytes:
    return b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)


def _times(events: DataFrame, number: str, block: str, tile: int) -> DataFrame:
    """(league_id, block, data): the times of each block of events, in order."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        data = _pack(pdf.sort_values(number)["time"].to_numpy(dtype=np.int64))
        return pd.DataFrame({"league_id": [key[0]], block: [key[1]], "data": [data]})

    rows = events.withColumn(block, F.floor(F.col(number) / tile))
    return rows.groupBy("league_id", block).applyInPandas(run, f"league_id string, {block} bigint, data binary")


def _names(names: DataFrame, tile: int) -> DataFrame:
    """The similarities (kind n) of each tile, places being counted inside it."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = (pdf[x].to_numpy(dtype=np.int64) % tile for x in ("i", "j"))
        return pd.DataFrame([(*key, "n", _pack(i, j, pdf["name"].to_numpy(dtype=np.float64)))], columns=[*_TILE, "kind", "data"])

    block = lambda x: F.floor(F.col(x) / tile)
    return names.withColumn("bi", block("i")).withColumn("bj", block("j")).groupBy(*_TILE).applyInPandas(run, _EDGES)


def _by_tile(rows: DataFrame, kernel, schema: str) -> DataFrame:
    """``kernel`` on the rows of each tile. Tiles are few bytes and much work, so their tasks must not be merged for being small."""
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(rows.repartition(tasks, *_TILE).groupBy(*_TILE).applyInPandas(kernel, schema))


class _Cell:
    """One tile as its rows give it: (kind, data)."""

    def __init__(self, pdf: pd.DataFrame, tile: int):
        self.data = dict(zip(pdf["kind"], pdf["data"], strict=True))
        self.complete = "z" in self.data
        if self.complete:
            self.bi, self.bj = int(pdf["bi"].iloc[0]), int(pdf["bj"].iloc[0])
            self.width = int(bytes(self.data["z"]))
            self.s, self.t = self._longs("s"), self._longs("t")
            self.shift = (self.bi - self.bj) * tile

    def _longs(self, kind: str) -> np.ndarray:
        return np.frombuffer(self.data[kind], dtype=np.int64)

    def _edge(self, kind: str, size: int) -> np.ndarray:
        return self._longs(kind) if kind in self.data else np.full(size, FAR)

    def sweep(self, steps: bool = False):
        i, j, value = self._longs("n").reshape(3, -1) if "n" in self.data else np.zeros((3, 0), dtype=np.int64)
        names = Names(i, j, value.view(np.float64), len(self.s) + len(self.t))
        corner = 0 if not self.bi and not self.bj else int(self._edge("corner", 1)[0])
        return sweep(self.s, self.t, names, self.shift, self.width, self._edge("top", len(self.t)), self._edge("left", len(self.s)), corner, steps)


def _forward(tile: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        cell, rows = _Cell(pdf, tile), []
        if cell.complete:
            bottom, right, _ = cell.sweep()
            at = (pdf["league_id"].iloc[0], cell.bi, cell.bj)
            for kind, down, over, data in (("top", 1, 0, bottom), ("left", 0, 1, right), ("corner", 1, 1, bottom[-1:])):
                if (data < FAR).any():
                    rows.append((at[0], at[1] + down, at[2] + over, kind, _pack(data)))
        return pd.DataFrame(rows, columns=[*_TILE, "kind", "data"])

    return run


def _back(tile: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        cell = _Cell(pdf, tile)
        i, j = (int(x) for x in bytes(cell.data["at"]).split(b","))
        path, i, j = walk(cell.sweep(steps=True)[2], i - cell.bi * tile, j - cell.bj * tile)
        league, down, over = pdf["league_id"].iloc[0], cell.bi * tile, cell.bj * tile
        rows = [(league, a + down, b + over, True) for a, b in path]
        if i + down >= 0 and j + over >= 0:
            rows.append((league, i + down, j + over, False))
        return pd.DataFrame(rows, columns=["league_id", "i", "j", "on_path"])

    return run


def _outside_path() -> Column:
    """As :func:`_outside`, an array of (i, j) of a league of ``n`` and ``m`` events."""
    steps = F.sequence(F.lit(0).cast("long"), F.greatest("n", "m") - 1)
    place = lambda k, own, other: F.when(F.col(own) > F.col(other), k).otherwise(F.greatest(k - F.col(other) + F.col(own), F.lit(0)))
    return F.transform(steps, lambda k: F.struct(place(k, "n", "m").alias("i"), place(k, "m", "n").alias("j")))


def align_leagues(pairs: DataFrame, tile: int = TILE, band: float = BAND) -> DataFrame:
    """(league_id, s, t, cost): the cheapest path through each league's events in order of (time, id).

    ``pairs`` has (league_id, s, s_time, t, t_time, name): all events of a league occur in it, pairs whose names have nothing
    in common may be left out. A pair that repeats counts with its largest similarity, a null one with 0; an event with
    several times with its earliest, without any at 0. Rows without a source or a target are left out. Where the last
    cell is outside the band the path goes diagonally up to its edge, or to the first event of a side.
    """
    pairs = pairs.filter(F.col("s").isNotNull() & F.col("t").isNotNull()).select("league_id", "s", "s_time", "t", "t_time", "name")
    pairs = cut(pairs.withColumn("league_id", F.coalesce("league_id", F.lit(""))))
    s, t = _numbered(pairs, "s", "i"), _numbered(pairs, "t", "j")
    sizes = s.groupBy("league_id").agg(F.count("*").alias("n")).join(t.groupBy("league_id").agg(F.count("*").alias("m")), "league_id")
    width = F.greatest(F.lit(1), F.ceil(F.greatest("n", "m") * F.lit(band))).cast("long")
    sizes = cut(sizes.withColumn("width", width).withColumn("over", F.abs(F.col("n") - F.col("m")) - F.col("width")))
    name = pairs.groupBy("league_id", "s", "t").agg(F.coalesce(F.max("name"), F.lit(0.0)).cast("double").alias("name"))
    names = name.join(s.select("league_id", F.col("id").alias("s"), "i"), ["league_id", "s"]).join(t.select("league_id", F.col("id").alias("t"), "j"), ["league_id", "t"])
    names = cut(names.select("league_id", "i", "j", "name"))

    inside = sizes.filter("over <= 1")
    last = lambda x: F.floor((F.col(x) - 1) / tile)
    live = inside.withColumn("bi", F.explode(F.sequence(F.lit(0).cast("long"), last("n"))))
    low = F.greatest(F.lit(0), F.floor((F.col("bi") * tile - F.col("width")) / tile)).cast("long")
    high = F.least(last("m"), F.floor((F.col("bi") * tile + tile - 1 + F.col("width")) / tile)).cast("long")
    live = cut(live.filter(low <= high).withColumn("bj", F.explode(F.sequence(low, high))).select(*_TILE, "width"))
    made = lambda df, kind, data: df.select(*_TILE, F.lit(kind).alias("kind"), data.alias("data"))
    fixed = made(live, "z", F.col("width").cast("string").cast("binary")).unionByName(_names(names, tile).join(live.select(*_TILE), _TILE, "left_semi"))
    fixed = fixed.unionByName(made(live.join(_times(s, "i", "bi", tile), ["league_id", "bi"]), "s", F.col("data")))
    fixed = cut(fixed.unionByName(made(live.join(_times(t, "j", "bj", tile), ["league_id", "bj"]), "t", F.col("data"))))

    waves = live.agg(F.max(F.col("bi") + F.col("bj"))).first()[0]
    wave = F.col("bi") + F.col("bj")
    edges: list[DataFrame] = []
    for w in range((-1 if waves is None else waves) + 1):
        rows = fixed.filter(wave == w)
        for earlier in edges[-2:]:
            rows = rows.unionByName(earlier.filter(wave == w))
        edges.append(_by_tile(rows, _forward(tile), _EDGES))
    for earlier in edges:
        fixed = fixed.unionByName(earlier)
    fixed = cut(fixed)

    beyond = sizes.filter("over > 1").select("league_id", F.explode(_outside_path()).alias("x")).select("league_id", "x.i", "x.j")
    path = beyond.unionByName(sizes.filter("over = 1").select("league_id", (F.col("n") - 1).alias("i"), (F.col("m") - 1).alias("j")))
    end = lambda x, y: (F.col(x) - 1 - F.when(F.col(x) - F.col(y) > F.col("width"), 1).otherwise(0)).alias({"n": "i", "m": "j"}[x])
    at = inside.select("league_id", end("n", "m"), end("m", "n"))
    found = [path]
    while not (at := cut(at)).isEmpty():
        place = F.concat_ws(",", F.col("i").cast("string"), F.col("j").cast("string")).cast("binary")
        here = at.select("league_id", F.floor(F.col("i") / tile).alias("bi"), F.floor(F.col("j") / tile).alias("bj"), F.lit("at").alias("kind"), place.alias("data"))
        rows = fixed.join(here.select(*_TILE), _TILE, "left_semi").unionByName(here)
        stepped = _by_tile(rows, _back(tile), _STEPS)
        found.append(stepped.filter("on_path").select("league_id", "i", "j"))
        at = stepped.filter("not on_path").select("league_id", "i", "j")
    for more in found[1:]:
        path = path.unionByName(more)

    side = lambda df, x, y: df.select("league_id", F.col("id").alias(x), F.col("time").alias(f"{x}_time"), y)
    rows = path.join(side(s, "s", "i"), ["league_id", "i"]).join(side(t, "t", "j"), ["league_id", "j"]).join(names, ["league_id", "i", "j"], "left")
    apart = (F.col("s_time") - F.col("t_time")).cast("double")
    cost = 1.0 - (F.coalesce("name", F.lit(0.0)) + F.exp(-(apart * apart) / (2.0 * DAY * DAY))) / 2.0
    return rows.select("league_id", "s", "t", cost.alias("cost"))
