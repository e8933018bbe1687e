"""Consistent-hash ring with virtual nodes and bounded loads (native).

The ring has ``CELLS`` cells. Each shard owns ``VNODES`` of them (its virtual nodes); a document's text decides its
cell, and the first virtual node clockwise names its shard, so equal texts go together. A shard takes no more rows than
its share (shares differ by at most one row); the rows of a cell beyond that continue clockwise to the next virtual node
whose shard has room. Law: ``rows``.

The ring and its counts are of a fixed size (``CELLS`` rows), whatever the input. Ranks inside a cell are counted in
sub-buckets, so that a cell that holds a third of all rows is spread over many tasks.

Defined results: a null text is empty (size 1, crc32 0); null ids and repeated rows are placed like any other row; an
empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import group_ranks, stored, table_of

CELLS = 4096
VNODES = 64


def ring(n_shards: int, vnodes: int = VNODES, cells: int = CELLS) -> list[tuple[int, int]]:
    """(cell, shard) of every virtual node, by cell. A taken cell sends the node on to its next hash."""
    if n_shards * vnodes > cells:
        raise ValueError("the ring has fewer cells than virtual nodes")
    at: dict[int, int] = {}
    for shard in range(n_shards):
        for v in range(vnodes):
            k = 0
            while (cell := int.from_bytes(hashlib.blake2b(f"{shard}/{v}/{k}".encode(), digest_size=8).digest(), "big") % cells) in at:
                k += 1
            at[cell] = shard
    return sorted(at.items())


def allocate(counts: dict[int, int], n_shards: int) -> list[list[int]]:
    """Rows [cell, first rank, end rank, shard, first slot]: which ranks of a cell go to which shard."""
    total = sum(counts.values())
    room = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    used = [0] * n_shards
    nodes = ring(n_shards)
    cells = [c for c, _ in nodes]
    out = []
    for cell in sorted(counts):
        done, k = 0, bisect.bisect_left(cells, cell)
        while done < counts[cell]:
            shard = nodes[k % len(nodes)][1]
            k += 1
            if take := min(counts[cell] - done, room[shard] - used[shard]):
                out.append([cell, done, done + take, shard, used[shard]])
                done, used[shard] = done + take, used[shard] + take
    return out


def place(docs: DataFrame, n_shards: int = 16) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = stored(
        docs.select(
            "doc_id",
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
            F.pmod(F.shiftrightunsigned(F.xxhash64(text), 20), F.lit(CELLS)).cast("int").alias("cell"),
        ),
        "ring",
    )
    counts = {r["cell"]: r["count"] for r in rows.groupBy("cell").count().collect()}  # at most CELLS rows
    ranked = group_ranks(rows, "cell", ["doc_id", "text_crc32", "size"], sum(counts.values()))
    spans = table_of(spark, allocate(counts, n_shards), "a_cell int, a_from long, a_to long, shard int, a_slot long")
    # at most CELLS + n_shards rows
    return ranked.join(F.broadcast(spans), (F.col("cell") == F.col("a_cell")) & (F.col("rank") >= F.col("a_from")) & (F.col("rank") < F.col("a_to"))).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        (F.col("a_slot") + F.col("rank") - F.col("a_from")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
