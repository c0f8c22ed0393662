"""Mixing sources to target weights by Pfair scheduling.

Each source's rows, in the order of a hash, are cut into blocks of ``block`` rows. Weights are exact
rationals: with w slots of every period of P (the weights as the smallest whole numbers of the same
proportions, and their sum), block k of a source is released at floor(k P / w) and due at
ceil((k + 1) P / w). One slot takes one block: the released block that is due first (ties: the source
first by name). The weights fill every slot, so earliest deadline first meets every deadline, and
after any number of slots each source is less than one block from its target.

The schedule repeats after a period, so only one period is computed, on the driver: a table whose
length follows from the weights, not from the input. Weights are never rounded: a period beyond
LONGEST slots is refused with ValueError, and the caller rounds as they see fit. Decimal weights mean
what they print (0.7 is 7/10); Fractions and whole numbers are taken as they are. When a source has
run out, the rest goes on in a new phase at the weights of those left.

Sources are as many as there are targets, LONGEST at most. Their totals and phases are on the driver,
never rows. Ranks are computed in buckets of the hash, about BUCKET rows of all sources each.

Defined cases: null sources are one source of their own, before all others by name; sources without a
weight get ``default``; an empty table gives an empty schedule; rows that are equal in all columns are
interchangeable, others with one id are ordered by a hash of their columns. Columns of the result that
the input has too (mix_slot and the like) are replaced; names that start with __mix_ are refused.
"""

from __future__ import annotations

import heapq
import math
from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

LONGEST = 1 << 18
BLOCK = 16
#: Rows expected in one bucket of the order.
BUCKET = 2_000
ADDED = ("mix_slot", "mix_block", "mix_release", "mix_deadline", "mix_phase", "mix_position")


def whole_weights(weights: dict) -> dict:
    """The weights as the smallest whole numbers of exactly the same proportions."""
    exact = {s: w if isinstance(w, Fraction) else Fraction(str(w)) for s, w in weights.items()}
    if any(w <= 0 for w in exact.values()):
        raise ValueError("weights must be positive")
    scale = math.lcm(*(w.denominator for w in exact.values()))
    whole = {s: int(w * scale) for s, w in exact.items()}
    common = math.gcd(*whole.values())
    whole = {s: w // common for s, w in whole.items()}
    if sum(whole.values()) > LONGEST:
        raise ValueError(f"the weights have a period of {sum(whole.values())} slots, {LONGEST} at most; round them first")
    return whole


def one_period(share: dict) -> list:
    """The source of each slot of a period, earliest deadline first among released blocks."""
    period = sum(share.values())
    waiting = [(0, s, 0) for s in sorted(share)]
    heapq.heapify(waiting)
    ready: list = []
    out = []
    for t in range(period):
        while waiting and waiting[0][0] <= t:
            _, s, k = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(k + 1) * period // share[s]), s, k))
        _, s, k = heapq.heappop(ready)
        out.append(s)
        heapq.heappush(waiting, ((k + 1) * period // share[s], s, k + 1))
    return out


def phases(blocks: dict, weights: dict) -> list[dict]:
    """Each phase: its first slot, period table, and per source the first block and number of blocks."""
    left, done, start, out = dict(blocks), dict.fromkeys(blocks, 0), 0, []
    while left := {s: n for s, n in left.items() if n > 0}:
        share = whole_weights({s: weights[s] for s in left})
        table = one_period(share)
        period = len(table)
        places: dict = {s: [] for s in left}
        for t, s in enumerate(table):
            places[s].append(t)
        slot_of = lambda s, k: k // share[s] * period + places[s][k % share[s]]
        end = min(slot_of(s, n - 1) for s, n in left.items()) + 1
        taken = {s: end // period * share[s] + sum(t < end % period for t in places[s]) for s in left}
        out.append({"start": start, "period": period, "places": places, "share": share, "first": {s: done[s] for s in left}, "blocks": taken})
        for s in left:
            done[s] += taken[s]
            left[s] -= taken[s]
        start += end
    return out


def mix_sources(docs: DataFrame, weights: dict | None = None, source_col: str = "source", id_col: str = "doc_id", block: int = BLOCK, default: float = 1) -> DataFrame:
    """The rows of ``docs`` with mix_slot, mix_block (of its source), mix_release, mix_deadline,
    mix_phase and mix_position (gapless from 0). Without weights every source has the same target."""
    spark = docs.sparkSession
    weights = weights or {}
    if any(c.startswith("__mix_") for c in docs.columns):
        raise ValueError("column names that start with __mix_ are reserved")
    s, b, h, r, p = (f"__mix_{c}" for c in "sbhrp")
    own = [f"`{c}`" for c in docs.columns if c not in ADDED]
    name = F.when(F.col(source_col).isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col(source_col).cast("string")))
    order = F.md5(F.concat_ws("/", F.lit("mix"), F.col(id_col).cast("string")).cast("binary"))
    # No more rows are compared than one bucket holds: buckets follow the order of the hash.
    n = docs.agg(F.count("*")).first()[0]
    bits = min(28, max(0, math.ceil(math.log2(max(1, n / BUCKET)))))
    bucket = F.shiftright(F.conv(F.substring(h, 1, 7), 16, 10).cast("long"), 28 - bits)
    rows = docs.select(*own, name.alias(s), order.alias(h)).withColumn(b, bucket)
    counts = rows.groupBy(s, b).agg(F.count("*").alias("__mix_n"))
    before = counts.select(s, b, (F.sum("__mix_n").over(Window.partitionBy(s).orderBy(b)) - F.col("__mix_n")).alias("__mix_before"))
    found = counts.groupBy(s).agg(F.sum("__mix_n").alias("n")).limit(LONGEST + 1).collect()
    if len(found) > LONGEST:
        raise ValueError(f"more than {LONGEST} sources")
    totals = {x[s]: x["n"] for x in found}
    per_source = {k: -(-c // block) for k, c in totals.items()}
    plan = phases(per_source, {k: weights.get(None if k == "n" else k[1:], default) for k in totals})

    spans, slots, short = [], [], []
    for i, ph in enumerate(plan):
        for k, first in ph["first"].items():
            if not ph["blocks"][k]:
                continue
            spans.append((i, k, first, first + ph["blocks"][k], ph["start"], ph["period"], ph["share"][k]))
            slots += [(i, k, j, t) for j, t in enumerate(ph["places"][k])]
            if first + ph["blocks"][k] == per_source[k] and totals[k] % block:
                last = ph["blocks"][k] - 1
                short.append((ph["start"] + last // ph["share"][k] * ph["period"] + ph["places"][k][last % ph["share"][k]], block - totals[k] % block))
    spans_df = spark.createDataFrame(spans, f"{p} int, {s} string, __mix_first long, __mix_end long, __mix_start long, __mix_period long, __mix_share long")
    slots_df = spark.createDataFrame(slots, f"{p} int, {s} string, __mix_i long, __mix_t long")
    missing = F.lit(0).cast("long")
    if short:
        gaps = F.from_json(F.lit(str([{"t": t, "m": m} for t, m in sorted(short)]).replace("'", '"')), T.ArrayType(T.StructType([T.StructField("t", T.LongType()), T.StructField("m", T.LongType())])))
        missing = F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + F.when(x["t"] < F.col("mix_slot"), x["m"]).otherwise(F.lit(0)))

    rank = F.row_number().over(Window.partitionBy(s, b).orderBy(h, F.col(id_col), F.xxhash64(*sorted(own)))) - 1
    placed = rows.withColumn(r, rank).join(before, [s, b]).withColumn(r, F.col(r) + F.col("__mix_before"))
    placed = placed.withColumn("mix_block", F.floor(F.col(r) / block))
    # Tables as long as the targets and a period: broadcast by that bound.
    placed = placed.join(F.broadcast(spans_df), (placed[s] == spans_df[s]) & (F.col("mix_block") >= F.col("__mix_first")) & (F.col("mix_block") < F.col("__mix_end"))).drop(spans_df[s])
    k, share, period, start = F.col("mix_block") - F.col("__mix_first"), F.col("__mix_share"), F.col("__mix_period"), F.col("__mix_start")
    placed = placed.withColumn("__mix_k", k).withColumn("__mix_i", k % share)
    placed = placed.join(F.broadcast(slots_df), [p, s, "__mix_i"])
    k = F.col("__mix_k")
    down = lambda x: F.floor((x - x % share) / share)
    placed = placed.withColumn("mix_slot", start + down(k) * period + F.col("__mix_t"))
    placed = placed.withColumn("mix_release", start + down(k * period)).withColumn("mix_deadline", start + down((k + 1) * period + share - 1))
    placed = placed.withColumn("mix_position", F.col("mix_slot") * block + F.col(r) % block - missing)
    return placed.select(*own, "mix_slot", "mix_block", "mix_release", "mix_deadline", F.col(p).alias("mix_phase"), "mix_position")
