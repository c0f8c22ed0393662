"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

The first 16 bits of a key's MD5 are its cell on a ring of CELLS cells; the next virtual node
clockwise names its shard. A shard takes rows up to its load bound in the order of their cells; what is
over goes on to the next other shard clockwise, and so on. The bounds add up to the number of rows and
differ by one at most, so the law is ``rows``: counts of shards are at most one apart, and a change of
the shards moves only rows of that shard's arcs and of overflows.

Overflow is settled on counts of cells, CELLS at most whatever the input: the driver gets one count a
cell and hands back intervals of ranks within cells (at most CELLS + shards**2 rows, broadcast by that
bound). Rows are ranked in buckets of their cell: by further digits of the key's hash as the input
grows, and by a hash of ``tie``, so rows of one key with differing ties are ranked in many tasks.

Defined cases: null keys are placed by their ties; rows equal in key and ties are interchangeable (and
ranked in one bucket); an empty table gives an empty one. Columns of the result that the input has too
(shard, slot, ring_shard, hops) are replaced; names that start with __ring_ are refused.
"""

from __future__ import annotations

import bisect
import hashlib
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CELLS = 1 << 16
VNODES = 64
#: Rows expected in one bucket of a cell before ties cut it further.
BUCKET = 1 << 12
ADDED = ("shard", "slot", "ring_shard", "hops")


def ring(shards: int, vnodes: int = VNODES) -> list[tuple[int, int]]:
    """The virtual nodes (cell, shard), clockwise."""
    cell = lambda s, v: int(hashlib.md5(f"{s}/{v}".encode()).hexdigest()[:4], 16)
    return sorted((cell(s, v), s) for s in range(shards) for v in range(vnodes))


def settle(counts: dict[int, int], shards: int, vnodes: int = VNODES) -> list[tuple[int, int, int, int, int, int, int]]:
    """(cell, first rank, end rank, shard, first slot, hops, ring shard) that place all rows within the bounds."""
    nodes = ring(shards, vnodes)
    at = [p for p, _ in nodes]
    total = sum(counts.values())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    used = [0] * shards
    waiting = []
    for c, n in sorted(counts.items()):
        i = bisect.bisect_left(at, c) % len(nodes)
        waiting.append((c, 0, n, i, (nodes[i][1],)))
    out = []
    while waiting:
        over = []
        for c, lo, hi, i, tried in waiting:
            s = tried[-1]
            take = min(hi - lo, room[s] - used[s])
            if take:
                out.append((c, lo, lo + take, s, used[s], len(tried) - 1, tried[0]))
                used[s] += take
            if lo + take < hi:
                while nodes[i][1] in tried:
                    i = (i + 1) % len(nodes)
                over.append((c, lo + take, hi, i, (*tried, nodes[i][1])))
        waiting = over
    return out


def assign_shards(df: DataFrame, key: Column, shards: int, vnodes: int = VNODES, tie: tuple[Column, ...] = ()) -> DataFrame:
    """``df`` with shard int, slot long (gapless from 0 in each shard), ring_shard int (before overflow) and hops int."""
    if any(c.startswith("__ring_") for c in df.columns):
        raise ValueError("column names that start with __ring_ are reserved")
    own = [f"`{c}`" for c in df.columns if c not in ADDED]
    text = key.cast("string")
    ties = F.concat_ws("/", F.lit("tie"), *(t.cast("string") for t in tie))
    md5 = lambda c: F.md5(c.cast("binary"))
    rows = df.select(*own, md5(F.coalesce(text, ties)).alias("__ring_h"), md5(ties).alias("__ring_t"), text.alias("__ring_key"))
    rows = rows.withColumn("__ring_cell", F.conv(F.substring("__ring_h", 1, 4), 16, 10).cast("int"))
    counts = {r["__ring_cell"]: r["n"] for r in rows.groupBy("__ring_cell").agg(F.count("*").alias("n")).collect()}  # CELLS rows at most
    more = max(0, math.ceil(math.log(max(1, sum(counts.values()) / CELLS / BUCKET), 16)))
    rows = rows.withColumn("__ring_sub", F.concat(F.substring("__ring_h", 5, more), F.substring("__ring_t", 1, 2)))
    spread = rows.groupBy("__ring_cell", "__ring_sub").agg(F.count("*").alias("__ring_n"))
    before = spread.select("__ring_cell", "__ring_sub", (F.sum("__ring_n").over(Window.partitionBy("__ring_cell").orderBy("__ring_sub")) - F.col("__ring_n")).alias("__ring_before"))
    names = "__ring_c int, __ring_lo long, __ring_hi long, shard int, __ring_slot long, hops int, ring_shard int"
    table = df.sparkSession.createDataFrame(settle(counts, shards, vnodes), names)
    rank = F.row_number().over(Window.partitionBy("__ring_cell", "__ring_sub").orderBy("__ring_h", "__ring_key", "__ring_t")).cast("long") - 1
    ranked = rows.withColumn("__ring_r", rank).join(before, ["__ring_cell", "__ring_sub"]).withColumn("__ring_r", F.col("__ring_r") + F.col("__ring_before"))
    found = ranked.join(F.broadcast(table), (F.col("__ring_cell") == F.col("__ring_c")) & (F.col("__ring_r") >= F.col("__ring_lo")) & (F.col("__ring_r") < F.col("__ring_hi")))
    return found.select(*own, "shard", (F.col("__ring_slot") + F.col("__ring_r") - F.col("__ring_lo")).alias("slot"), "ring_shard", "hops")
