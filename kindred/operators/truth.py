"""Truth values (frequency f, confidence c) and pools of judgment patterns with them.

Evidence for a truth value is c / (1 - c) units, f of them positive; revising adds evidence. Confidence is
capped at CAP (pass None for the variant without a cap, whose evidence counts in units of ``k``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CAP = 0.9999
#: Fixed value: confidence of one observation.
OBSERVED = 0.9


def truth(f: Column, c: Column) -> Column:
    return F.struct(f.cast("double").alias("f"), c.cast("double").alias("c"))


def _capped(c: Column, cap: float | None) -> Column:
    return c if cap is None else F.least(c, F.lit(cap))


def expectation(t: Column) -> Column:
    return t["c"] * (t["f"] - 0.5) + 0.5


def evidence(t: Column, k: float = 1.0, cap: float | None = CAP) -> tuple[Column, Column]:
    """Positive and negative evidence; full confidence counts as a million units (ten of ``k`` without a cap)."""
    unit = 1.0 if cap is not None else k
    full = 1e6 if cap is not None else 10 * k
    amount = F.when(t["c"] < 1, F.try_divide(t["c"] * unit, 1 - t["c"])).otherwise(full)
    return t["f"] * amount, (1 - t["f"]) * amount


def from_evidence(pos: Column, neg: Column, k: float = 1.0, cap: float | None = CAP) -> Column:
    """No evidence: f 0.5 and c 0."""
    total = pos + neg
    return truth(F.coalesce(F.try_divide(pos, total), F.lit(0.5)), _capped(total / (total + k), cap))


def revision(a: Column, b: Column, k: float = 1.0, cap: float | None = CAP) -> Column:
    (p, n), (q, m) = evidence(a, k, cap), evidence(b, k, cap)
    return from_evidence(p + q, n + m, k, cap)


def deduction(a: Column, b: Column, cap: float | None = CAP) -> Column:
    return truth(a["f"] * b["f"], _capped(a["c"] * b["c"] * a["f"] * b["f"], cap))


def abduction(a: Column, b: Column, cap: float | None = CAP) -> Column:
    return truth(b["f"], _capped(a["c"] * b["c"] * a["f"], cap))


def induction(a: Column, b: Column, cap: float | None = CAP) -> Column:
    return truth(a["f"], _capped(a["c"] * b["c"] * b["f"], cap))


def comparison(a: Column, b: Column, cap: float | None = CAP) -> Column:
    low, high = F.least(a["f"], b["f"]), F.greatest(a["f"], b["f"])
    return truth(F.coalesce(F.try_divide(low, high), F.lit(0.0)), _capped(a["c"] * b["c"] * (a["f"] + b["f"]), cap))


def pattern_pool(judged: DataFrame, most: int | None = None, by_distance: bool = True, k: float = 1.0, cap: float | None = CAP, weight: str | None = None) -> DataFrame:
    """(pattern, n_match, n_non, f, c, expectation) from (label, judgments).

    A pattern is the sorted judgment set; each observation is evidence for or against it, and evidence
    adds up, so one map-side combined aggregation replaces revising pair by pair (equal below the cap). ``most``:
    keep those whose expectation is farthest from 0.5, or highest. ``weight``: a column that says how many pairs a row stands for.
    """
    unit = OBSERVED / (1 - OBSERVED) * (1.0 if cap is not None else k)
    each = F.lit(1) if weight is None else F.col(weight)
    n = judged.groupBy(F.sort_array("judgments").alias("pattern")).agg(F.sum(F.col("label") * each).alias("n_match"), F.sum((1 - F.col("label")) * each).alias("n_non"))
    t = from_evidence(F.col("n_match") * unit, F.col("n_non") * unit, k, cap)
    pool = n.withColumn("t", t).select("pattern", "n_match", "n_non", "t.f", "t.c", expectation(F.col("t")).alias("expectation"))
    if most is None:
        return pool
    rank = F.abs(F.col("expectation") - 0.5) if by_distance else F.col("expectation")
    return pool.orderBy(F.round(rank, 12).desc(), F.array_join("pattern", ",")).limit(most)


def pattern_scores(judged: DataFrame, pool: DataFrame, n_patterns: int = 10, k: float = 1.0, cap: float | None = CAP) -> DataFrame:
    """``judged`` with f, c and score, its match with the pool's most and least expected patterns.

    Half of ``n_patterns`` from either end; each one's similarity (shared judgments over the larger set), at its own
    confidence, is revised with its truth value, and the results are revised in order. They are n_patterns
    rows, broadcast as one array.
    """
    half, text = max(1, n_patterns // 2), F.array_join("pattern", ",")
    place = pool.select("pattern", "f", "c", F.round("expectation", 12).alias("e"), text.alias("text"))
    top = place.orderBy(F.col("e").desc(), "text").limit(half).withColumn("side", F.lit(0))
    # The low end is the tail of the same order; a pool of no more than one half has none.
    more = pool.limit(half + 1).agg((F.count("*") > half).alias("more"))
    low = place.orderBy(F.col("e"), F.col("text").desc()).limit(half).withColumn("side", F.lit(1)).crossJoin(F.broadcast(more)).where("more").drop("more")
    order = F.row_number().over(Window.orderBy("side", F.col("e").desc(), "text"))
    unit, full = (1.0, 1e6) if cap is not None else (k, 10 * k)
    weight = F.when(F.col("c") < 1, F.try_divide(F.col("c") * unit, 1 - F.col("c"))).otherwise(full)
    # Evidence as it is after a revision: rescaled where confidence is capped or counts in other units.
    held = (lambda t: F.least(t / k, F.lit(cap / (1 - cap)))) if cap is not None else (lambda t: t)
    some = top.unionByName(low).withColumn("i", order).select("i", "pattern", "f", (held(2 * weight) / 2).alias("u"))
    one = some.agg(F.sort_array(F.collect_list(F.struct("i", "pattern", "f", "u"))).alias("pool"))  # n_patterns entries

    def seen(p: Column) -> Column:
        longest = F.greatest(F.size("judgments"), F.size(p["pattern"]))
        alike = F.try_divide(F.size(F.array_intersect(F.col("judgments"), p["pattern"])), longest)
        return F.struct(((alike + p["f"]) * p["u"]).alias("p"), (2 * p["u"]).alias("t"))

    def step(acc: Column, x: Column) -> Column:
        total = acc["t"] + x["t"]
        share = F.when(acc["t"] == 0, F.lit(1.0)).otherwise(held(total) / total)
        return F.struct(((acc["p"] + x["p"]) * share).alias("p"), (total * share).alias("t"))

    parts = F.filter(F.transform("pool", seen), lambda x: x["p"].isNotNull())
    zero = F.struct(F.lit(0.0).alias("p"), F.lit(0.0).alias("t"))
    out = judged.crossJoin(F.broadcast(one)).withColumn("t", F.aggregate(parts, zero, step)).drop("pool")
    f, c = F.coalesce(F.try_divide(F.col("t.p"), F.col("t.t")), F.lit(0.5)), F.col("t.t") / (F.col("t.t") + unit)
    return out.withColumns({"f": f, "c": c}).withColumn("score", F.col("c") * (F.col("f") - 0.5) + 0.5).drop("t")
