"""N-gram Jaccard join by a blocked product of the sparse document by n-gram incidence matrix.

Columns are hashed n-grams. What decides is the product of the matrix with its transpose, made one block of columns at a
time: the documents' rows in a block meet, a pair's overlap in it is added to what it has, and a pair is dropped as soon
as its count and what the blocks left can add at most stay below the bound that follows from the two sizes. The product
is made for pairs that can still reach their bound, found in three steps, none of which loses a link:

* Columns are hashed into blocks, more of them than two linked documents can differ in (at most ``(den - num) /
  (den + num)`` of both sizes), so linked documents are alike in a block that is not empty; how many such blocks a
  document must share at least follows from its size. In a block that many share, each is paired with the smallest only.
* A pair is dropped where the sizes of its rows in fine blocks of columns, summed up as the smaller of the two, stay
  below its bound. Only these counts are shuffled, no texts or n-grams.
* What the product links is a component. Documents that share enough blocks with other components are paired across them by
  their rare n-grams, again with the bound that follows from sizes and places.

Documents with equal sets are one class and are compared once, and a large group of near copies costs a multiple of its
size. Blocks and columns that very many documents share are salted, hubs are cut into tiles.

Defined results: a null or empty text, or one without words, has an empty set and links with nothing; a null id is a
document like any other whose component is named by the ids in it (null if there are none); rows that repeat an id and
a text are one document; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import HOT_SHARE, join_salted, release, salted, settled, stored, whole_row, with_key
from .graph import components
from .shingles import mix, shingle_sets, sliced

#: Size classes grow by this factor; each has its own number of blocks.
RATIO = 1.5
#: Blocks of columns that the product is made in, by the first bit of the hash; it drops pairs after each.
PARTS = 2
#: Members of a hub that meet it in one tile, and documents of a column that meet in one task.
TILE = 4096
#: One document in SAMPLE is asked which blocks very many share. This settles routes only, never a result.
SAMPLE = 64
SALTS = 256


@cache
def size_class(size: int) -> int:
    return max(0, math.floor(math.log(size, RATIO) + 1e-9))


@cache
def lowest(c: int) -> int:
    """The smallest size of a class."""
    n = max(1, math.floor(RATIO**c) - 2)
    while size_class(n) < c:
        n += 1
    return n


@cache
def blocks(c: int, num: int, den: int) -> tuple[int, int]:
    """(blocks, spare) of the pairs whose larger document is in class c; no blocks where only equal sets can link.

    ``spare`` blocks beyond those that may differ make up for blocks that are empty by chance.
    """
    most = lowest(c + 1) - 1
    differ = 2 * most * (den - num) // (den + num)
    if not differ:
        return 0, 0
    least = -(-lowest(c) * num // den)
    spare = 2
    for _ in range(50):
        empty = (differ + 1 + spare) * math.exp(-least / (differ + 1 + spare))
        if spare >= (want := max(2, math.ceil(empty + 4 * math.sqrt(empty)))) or spare > 4 * differ:
            break
        spare = want
    return differ + 1 + spare, spare


def classes_of(size: int, num: int, den: int) -> list[int]:
    """The classes in which a document looks for partners: its own, and the next if a larger partner may be there."""
    c = size_class(size)
    return [c, c + 1] if size * den >= lowest(c + 1) * num else [c]


def widest(c: int, size: int, num: int, den: int) -> int:
    """The most columns in which a document can differ from a linked one, where the larger is in class c."""
    return (den - num) * (size + min(lowest(c + 1) - 1, size * den // num)) // (den + num)


def block_keys(sets: list[np.ndarray], num: int, den: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The hashed contents of each document's non-empty blocks, and a code for each.

    A document is keyed in one or two classes (see :func:`classes_of`). The lowest bit of a code says in which, the
    others how many of these keys it shares with any document it links with there.

    A document with more empty blocks than are spared may be alike to a partner in empty blocks alone. Such a partner
    has as many; both also get their first n-grams as keys, so many that linked documents share one.
    """
    out: list[list[np.ndarray]] = [[] for _ in sets]
    codes: list[list[np.ndarray]] = [[] for _ in sets]
    jobs = [(i, c, *blocks(c, num, den)) for i, s in enumerate(sets) if len(s) for c in classes_of(len(s), num, den)]
    jobs = [j for j in jobs if j[2]]
    if not jobs:
        return [np.zeros(0, dtype=np.uint64) for _ in sets], [np.zeros(0, dtype=np.int32) for _ in sets]
    many = np.asarray([len(sets[i]) for i, *_ in jobs])
    count = np.asarray([b for *_, b, _ in jobs])
    first = np.concatenate(([0], np.cumsum(count)))
    values = np.concatenate([sets[i] for i, *_ in jobs])
    job = np.repeat(np.arange(len(jobs)), many)
    block = first[job] + (mix(values, 1) % count[job].astype(np.uint64)).astype(np.int64)
    order = np.argsort(block, kind="stable")
    full, at = np.unique(block[order], return_index=True)
    sums = np.add.reduceat(mix(values[order], 2), at)
    owner = np.searchsorted(first, full, side="right") - 1
    kind = np.asarray([c for _, c, *_ in jobs], dtype=np.uint64)
    keys = mix(sums + mix(kind[owner] * np.uint64(1 << 32) + (full - first[owner]).astype(np.uint64), 4), 5)
    ends = np.searchsorted(full, first)
    for j, (i, c, n, spare) in enumerate(jobs):
        s, e = int(ends[j]), int(ends[j + 1])
        size = len(sets[i])
        own = [keys[s:e]]
        if n - (e - s) > spare:
            own.append(mix(sets[i][: size - -(-size * num // den) + 1], 6))
        share = max(1, e - s - widest(c, size, num, den))
        out[i] += own
        codes[i].append(np.full(sum(map(len, own)), 2 * share + (c != size_class(size)), dtype=np.int32))
    return [np.concatenate(o) if o else np.zeros(0, dtype=np.uint64) for o in out], [np.concatenate(o) if o else np.zeros(0, dtype=np.int32) for o in codes]


def profile(grams: np.ndarray) -> np.ndarray:
    """How many of a sorted set's n-grams fall into each of a power of two of blocks of columns, about four in one."""
    bits = max(3, math.ceil(math.log2(max(len(grams), 1) / 4)))
    return np.bincount((grams >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits).astype("<u4")


def room(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The most that two profiles can have in common in each of ``PARTS`` blocks."""
    while len(x) != len(y):
        longer, shorter = (x, y) if len(x) > len(y) else (y, x)
        x, y = longer.reshape(-1, 2).sum(axis=1), shorter
    return np.minimum(x, y).reshape(PARTS, -1).sum(axis=1)


def needed(na, nb, num: int, den: int):
    """The overlap from which two sizes link."""
    return -(-num * (na + nb) // (num + den))


def _keyed(docs: DataFrame) -> DataFrame:
    return with_key(docs, F.col("doc_id").cast("long").alias("doc_id")).select("doc_id", _node().alias("node"), "text")


def _node() -> Column:
    return F.when(F.col("_tie") == 0, F.col("_id")).otherwise(F.xxhash64("_id", "_tie"))


def set_rows(keyed: DataFrame, k: int) -> DataFrame:
    """(doc_id, node, n, s1, s2, profile) of each document: size, 128-bit signature and block sizes of its set."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = pdf["text"].tolist()
            for s, e in sliced(texts):
                sets = shingle_sets(texts[s:e], k)
                sums = [[int(np.add.reduce(mix(x, seed)).astype(np.int64)) for x in sets] for seed in (7, 8)]
                out = pdf.iloc[s:e][["doc_id", "node"]]
                yield out.assign(n=[len(x) for x in sets], s1=sums[0], s2=sums[1], profile=[profile(x).tobytes() for x in sets])

    return keyed.mapInPandas(run, "doc_id long, node long, n long, s1 long, s2 long, profile binary")


def key_rows(keyed: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(node, key, code) of each document's blocks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = pdf["text"].tolist()
            for s, e in sliced(texts):
                keys, codes = block_keys(shingle_sets(texts[s:e], k), num, den)
                yield pd.DataFrame({"node": pdf["node"].iloc[s:e], "keys": [x.view(np.int64) for x in keys], "codes": codes})

    rows = keyed.select("node", "text").mapInPandas(run, "node long, keys array<long>, codes array<int>")
    return rows.select("node", F.explode(F.arrays_zip("keys", "codes")).alias("x")).select("node", F.col("x.keys").alias("key"), F.col("x.codes").alias("code"))


def _sharing_enough(rows: DataFrame) -> DataFrame:
    """Those of the rows (node, code, ...) whose document shares as many keys as its links need."""
    enough = rows.groupBy("node", "code").count().filter("count >= shiftright(code, 1)").select("node", "code")
    return rows.join(enough, ["node", "code"], "left_semi")


def incidence(texts: DataFrame, k: int) -> DataFrame:
    """(node, part, grams): each document's row of the matrix, cut into ``PARTS`` blocks of columns."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        marks = np.asarray([(i << 64) // PARTS for i in range(1, PARTS)], dtype=np.uint64)
        for pdf in batches:
            texts = pdf["text"].tolist()
            for s, e in sliced(texts):
                cut = [np.split(x.view(np.int64), np.searchsorted(x, marks)) for x in shingle_sets(texts[s:e], k)]
                nodes = np.repeat(pdf["node"].to_numpy()[s:e], PARTS)
                yield pd.DataFrame({"node": nodes, "part": list(range(PARTS)) * (e - s), "grams": [x for c in cut for x in c]})

    return texts.select("node", "text").mapInPandas(run, "node long, part int, grams array<long>")


def hopeful(pairs: DataFrame, reps: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b, tiles, need, late) of the pairs whose rows leave room for a link: tiles of hub a, room after the first block."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            need = needed(pdf["na"].to_numpy(), pdf["nb"].to_numpy(), num, den)
            fits = np.minimum(pdf["na"], pdf["nb"]).to_numpy() >= need
            late = np.zeros(len(pdf), dtype=np.int64)
            x, y = pdf["pa"].tolist(), pdf["pb"].tolist()
            for i in np.flatnonzero(fits).tolist():
                r = room(np.frombuffer(x[i], dtype="<u4"), np.frombuffer(y[i], dtype="<u4"))
                fits[i], late[i] = r.sum() >= need[i], r[1:].sum()
            yield pdf.loc[fits, ["a", "b", "tiles"]].assign(need=need[fits], late=late[fits])

    fan = pairs.groupBy("a").agg(F.count("*").alias("fan"))
    fan = fan.withColumn("tiles", F.ceil(F.col("fan") / TILE).cast("int"))
    hubs = stored(fan.join(reps.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("profile").alias("pa")), "a"), "hubs")
    total = hubs.agg(F.sum("fan")).first()[0] or 0
    members = reps.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("profile").alias("pb"))
    return join_salted(pairs, hubs, "a", "fan", total).join(members, "b").select("a", "b", "tiles", "na", "nb", "pa", "pb").mapInPandas(run, "a long, b long, tiles int, need long, late long")


def product(pairs: DataFrame, keyed: DataFrame, reps: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Those of the pairs (a, b) of a stored table that link, by overlaps added up block by block."""
    tile = F.pmod(F.xxhash64("b"), "tiles").cast("int")
    left = stored(hopeful(pairs, reps, num, den).select("a", "b", tile.alias("tile"), "need", "late", F.lit(0).cast("long").alias("c")), "hopeful")
    nodes = left.select(F.col("a").alias("node")).unionByName(left.select(F.col("b").alias("node"))).distinct()
    rows = stored(incidence(keyed.join(nodes, "node", "left_semi"), k), "incidence")
    for part in range(PARTS):
        block = rows.filter(F.col("part") == part)
        hubs = left.select("a", "tile").distinct().join(block, F.col("a") == F.col("node")).select("a", "tile", F.col("grams").alias("ga"))
        members = left.join(block, F.col("b") == F.col("node")).select("a", "tile", "b", "need", "late", "c", F.col("grams").alias("gb"))
        overlap = F.sum(F.size(F.array_intersect("ga", "gb")))
        added = members.join(hubs, ["a", "tile"]).groupBy("a", "b", "tile", "need", "late", "c").agg(overlap.alias("more"))
        more = F.col("c") + F.col("more")
        rest = F.lit(0) if part == PARTS - 1 else F.col("late")
        left = stored(added.filter(more + rest >= F.col("need")).select("a", "b", "tile", "need", "late", more.alias("c")), "overlaps")
    release(rows)
    return left.select("a", "b")


def _shared_blocks(keyed: DataFrame, reps: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(key, node, code, lead, salt) of the blocks that several documents share; ``lead`` is the smallest document of the block or,
    in a block that very many share, of the document's own part of it."""
    asked = key_rows(keyed.filter(F.pmod(F.xxhash64("node"), F.lit(SAMPLE)) == 0), k, num, den).groupBy("key").count().filter("count > 31")
    asked = stored(asked, "asked")
    total = asked.agg(F.sum("count")).first()[0] or 0
    hot = asked.filter(F.col("count") * HOT_SHARE > total).select("key")
    entries = key_rows(keyed.join(reps.select("node"), "node", "left_semi"), k, num, den)
    dealt = salted(entries, hot, "key", ["node"], SALTS, "salt")
    w = Window.partitionBy("key", "salt").orderBy("node")
    found = dealt.select("key", "node", "code", "salt", F.first("node").over(w).alias("lead"), F.lag("node").over(w).alias("before"), F.lead("node").over(w).alias("after"))
    return found.filter((F.col("salt") >= 0) | F.col("before").isNotNull() | F.col("after").isNotNull()).select("key", "node", "code", "lead", "salt")


def near_classes(keyed: DataFrame, rows: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(node, label) of the class representatives that link with others."""
    reps = stored(rows.filter("n > 0").groupBy("s1", "s2", "n").agg(F.min("node").alias("node"), F.first("profile").alias("profile")).select("node", "n", "profile"), "reps")
    blocks_ = stored(_shared_blocks(keyed, reps, k, num, den), "blocks")
    shared = stored(_sharing_enough(blocks_), "shared")
    release(blocks_)
    parts = shared.filter("salt >= 0").select("key", "lead").distinct()  # at most SALTS for a block
    chief = parts.groupBy("key").agg(F.min("lead").alias("a"))
    star = shared.filter("node != lead").select(F.col("lead").alias("a"), F.col("node").alias("b"))
    star = stored(star.unionByName(parts.join(chief, "key").filter("a != lead").select("a", F.col("lead").alias("b"))).distinct(), "star")
    links = product(star, keyed, reps, k, num, den)
    first = components(links)
    across = stored(_across(keyed, shared, star, first, k, num, den), "across")
    release(shared, star)
    return components(links.unionByName(product(across, keyed, reps, k, num, den)))


def _across(keyed: DataFrame, shared: DataFrame, tried: DataFrame, labels: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Pairs (a, b) between different components that may link: candidates of the documents whose blocks hold several.

    Their n-grams are ordered by how many of these documents have them, rare ones first. A linked pair shares one of the
    first ``n - num / den * n + 1`` of both, so early that the overlap that is left can reach the bound. Documents of a
    large group that are alike but not enough differ in rare n-grams first, and do not meet. Columns of one component
    are left out, and only documents of like size meet in the others.
    """
    held = stored(shared.join(labels, "node", "left").select("key", "node", "code", F.coalesce("label", "node").alias("label")), "held")
    spread = held.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("m"))
    spread = stored(spread.filter("low != high").select("key", "m"), "spread")
    some = _sharing_enough(join_salted(held, spread, "key", "m", held.count())).select("node", "label").distinct()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = pdf["text"].tolist()
            for s, e in sliced(texts):
                sets = shingle_sets(texts[s:e], k)
                rows = pdf.iloc[s:e][["node", "label"]]
                yield rows.assign(n=[len(x) for x in sets], grams=[x.view(np.int64) for x in sets])

    mixed = keyed.select("node", "text").join(some, "node").select("node", "label", "text")
    mixed = stored(mixed.mapInPandas(run, "node long, label long, n int, grams array<long>"), "mixed")
    entries = mixed.select("node", "label", "n", F.explode("grams").alias("gram"))
    total = mixed.agg(F.sum("n")).first()[0] or 0
    often = stored(entries.groupBy("gram").agg(F.count("*").alias("df")).filter("df > 1").withColumn("m", F.col("df")), "often")
    common = join_salted(entries, often, "gram", "m", total)
    own = Window.partitionBy("node", "label", "n")
    # n-grams of one document only come first; they are counted, not kept
    place = (F.col("n") - F.count("*").over(own) + F.row_number().over(own.orderBy("df", "gram"))).cast("int")
    first = F.col("n") - F.ceil(F.col("n") * num / F.lit(den)) + 1
    prefix = stored(common.withColumn("place", place).filter(F.col("place") <= first).select("gram", "node", "label", "n", "place"), "prefix")
    column = prefix.groupBy("gram").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("m")).filter("low != high")
    column = stored(column.select("gram", "m", F.ceil(F.col("m") / TILE).cast("int").alias("tiles")), "columns")
    active = join_salted(prefix, column, "gram", "m", prefix.count())
    # a size class is a little wider than the sizes that a document links with, so partners are in its own or the next
    of_size = F.floor(F.log("n") / math.log(1.001 * den / num)).cast("int")
    a = active.select("gram", F.pmod(F.xxhash64("node"), "tiles").cast("int").alias("tile"), F.explode(F.array(of_size, of_size + 1)).alias("kind"), *[F.col(c).alias(f"{c}_a") for c in ("node", "label", "n", "place")])
    b = active.select("gram", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"), of_size.alias("kind"), *[F.col(c).alias(f"{c}_b") for c in ("node", "label", "n", "place")])
    left = 1 + F.least(F.expr("n_a - place_a"), F.expr("n_b - place_b"))
    meet = F.expr("(n_a < n_b or n_a = n_b and node_a < node_b) and label_a != label_b") & ((num + den) * left >= num * F.expr("n_a + n_b"))
    pairs = a.join(b, ["gram", "tile", "kind"]).filter(meet).select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct()
    return pairs.join(tried, ["a", "b"], "left_anti")


def near_duplicates(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row per document: doc_id, node, n_shingles, component_id (smallest doc_id reachable by links) and label.

    Documents link when ``den * intersection >= num * union`` of their sets of ``k``-word shingles. ``label`` is the
    smallest node of the component; a node is a document's id, or, where ids repeat, a hash of id and text.
    """
    keyed = _keyed(docs)
    rows = stored(set_rows(keyed, k), "sets")
    labels = near_classes(keyed, rows, k, num, den)
    groups = rows.filter("n > 0").groupBy("s1", "s2", "n").agg(F.min("node").alias("rep"), F.min("doc_id").alias("low"))
    named = groups.join(labels, F.col("rep") == F.col("node"), "left").select("s1", "s2", "n", "low", F.coalesce("label", "rep").alias("label"))
    named = stored(named, "classes")
    lows = named.groupBy("label").agg(F.min("low").alias("component_id"))
    of = named.join(lows, "label").select(F.col("s1").alias("_s1"), F.col("s2").alias("_s2"), F.col("n").alias("_n"), "component_id", "label")
    # documents without words are no class: each goes by its own node
    mine = rows.withColumn("_at", F.when(F.col("n") > 0, F.col("s1")).otherwise(F.col("node")))
    found = mine.join(of, (F.col("_at") == F.col("_s1")) & (F.col("s2") == F.col("_s2")) & (F.col("n") == F.col("_n")), "left")
    return found.select(
        "doc_id",
        "node",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        F.when(F.col("n") > 0, F.col("label")).otherwise(F.col("node")).alias("label"),
    )


def keep_first(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """Of each component its document with the smallest id, with all columns; of rows that repeat an id and a text, one stays."""

    def firsts() -> DataFrame:
        found = near_duplicates(docs, k, num, den)
        # nodes are hashes where ids repeat; the smallest id stays all the same, a null id before all others
        return found.groupBy("label").agg(F.min(F.struct(F.coalesce("doc_id", F.lit(-(2**63))), "node")).alias("x")).select("x.node")

    first = settled(firsts, "kept")
    rows = with_key(docs, whole_row(docs).alias("_row")).select("_row", _node().alias("node"))
    if not rows.groupBy("node").count().filter("count > 1").limit(1).isEmpty():
        rows = rows.dropDuplicates(["node"])
    return rows.join(first, "node", "left_semi").select("_row.*")
