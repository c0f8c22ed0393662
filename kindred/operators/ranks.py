"""Global ranks and exact quantiles without sorting a whole table in one task."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows expected in one bucket of a hash order.
BUCKET = 20_000
#: Rank error of the sketch that brackets a quantile, as a share of the rows.
SKETCH = 1000


def hash_rank(df: DataFrame, h: Column, *tie: str, bits: int = 31, name: str = "rank") -> DataFrame:
    """``df`` with its rank from 0 by a number ``h`` in [0, 2**bits), then ``tie``.

    Rows are ranked in buckets of the number's leading bits; the counts before a bucket are added.
    """
    n = df.count()
    cut = min(bits, max(0, math.ceil(math.log2(max(1, n / BUCKET)))))
    rows = df.withColumn("__h", h).withColumn("__b", F.shiftright("__h", bits - cut))
    return _ranked(rows, ["__h", *tie], name).drop("__h")


def ordered_rank(df: DataFrame, *cols: str, name: str = "rank", ranges: int = 256) -> DataFrame:
    """``df`` with its rank from 0 in the order of ``cols``; the first one is a number, cut into ranges by a sketch."""
    points = df.agg(F.percentile_approx(cols[0], [k / ranges for k in range(1, ranges)], 10_000)).first()[0] or []
    bounds = sorted(set(points))
    at = sum((F.when(F.col(cols[0]) >= p, 1).otherwise(0) for p in bounds), F.lit(0)) if len(bounds) <= 16 else F.size(F.filter(F.array(*map(F.lit, bounds)), lambda p: F.col(cols[0]) >= p))
    return _ranked(df.withColumn("__b", at), list(cols), name)


def _ranked(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    counts = rows.groupBy("__b").agg(F.count("*").alias("__n"))
    before = counts.select("__b", (F.sum("__n").over(Window.orderBy("__b")) - F.col("__n")).alias("__before"))  # a row a bucket
    inside = F.row_number().over(Window.partitionBy("__b").orderBy(*order)) - 1
    return rows.withColumn("__r", inside).join(before, "__b").withColumn(name, F.col("__r") + F.col("__before")).drop("__b", "__r", "__before")


def quantiles(df: DataFrame, value: str, qs: list[float], by: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """(*by, q, x): exact quantiles with linear interpolation; nulls are left out. ``weight``: how often a row counts.

    Two passes: a sketch brackets each quantile, then only values inside the bracket (a few thousandths of
    the rows) are counted by value and walked through in order.
    """
    by = by or []
    rows = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("__x"), (F.lit(1) if weight is None else F.col(weight)).cast("long").alias("__w"))
    eps = 2.0 / SKETCH
    low, high = [max(0.0, q - eps) for q in qs], [min(1.0, q + eps) for q in qs]
    # Rows with weights are distinct values, counted before; they are few, and all of them are walked through.
    sketch = (lambda q: F.percentile_approx("__x", q, SKETCH)) if weight is None else (lambda q: F.array(*(F.min("__x") if q is low else F.max("__x") for _ in qs)))
    marks = rows.groupBy(*by).agg(F.sum("__w").alias("__n"), sketch(low).alias("__lo"), sketch(high).alias("__hi"), F.min("__x").alias("__min"), F.max("__x").alias("__max"))
    each = marks.select(*by, "__n", F.posexplode(F.array(*map(F.lit, qs))).alias("__i", "q"), "__lo", "__hi", "__min", "__max")
    edge = lambda c, end, hit: F.when(hit, F.col(end)).otherwise(F.element_at(c, F.col("__i") + 1))
    each = each.select(*by, "q", (F.col("q") * (F.col("__n") - 1)).alias("__at"), edge("__lo", "__min", F.col("q") <= eps).alias("__lo"), edge("__hi", "__max", F.col("q") >= 1 - eps).alias("__hi"))
    met = rows.join(each, by) if by else rows.crossJoin(F.broadcast(each))  # a row a quantile
    counted = met.where(F.col("__x") <= F.col("__hi")).groupBy(*by, "q", "__at", F.when(F.col("__x") >= F.col("__lo"), F.col("__x")).alias("__x")).agg(F.sum("__w").alias("__c"))
    end = F.sum("__c").over(Window.partitionBy(*by, "q").orderBy(F.col("__x").asc_nulls_first())).alias("__end")
    walked = counted.select(*by, "q", "__at", "__x", "__c", end).where("__x is not null")
    pick = lambda rank: F.min(F.when(F.col("__end") > rank, F.col("__x")))
    got = walked.groupBy(*by, "q", "__at").agg(pick(F.floor("__at")).alias("__a"), pick(F.ceil("__at")).alias("__b"))
    return got.select(*by, "q", (F.col("__a") + (F.col("__b") - F.col("__a")) * (F.col("__at") - F.floor("__at"))).alias("x"))


def row_at(df: DataFrame, places: list[int] | list[float], h: Column, *tie: str, bits: int = 31, cells: int = 16) -> list[tuple | None]:
    """(h, *tie) of the rows at some ranks from 0, in the order of a number ``h`` in [0, 2**bits), then ``tie``; None
    beyond the last. A float is a share of the rows, rounded down.

    Rows don't move: one pass counts them by the number's leading bits, a second one takes those of the cells that hold the ranks.
    """
    rows = df.select(h.alias("__h"), *tie).withColumn("__b", F.shiftright("__h", bits - cells))
    counts = sorted((r["__b"], r["count"]) for r in rows.groupBy("__b").count().collect())  # 2**cells rows at most
    n = sum(c for _, c in counts)
    wanted, before = {}, 0
    ranks = [int(p * n) if isinstance(p, float) else p for p in places]
    for b, c in counts:
        for p in ranks:
            if before <= p < before + c:
                wanted[p] = (b, p - before)
        before += c
    if not wanted:
        return [None for _ in ranks]
    some = rows.where(F.col("__b").isin(sorted({b for b, _ in wanted.values()})))
    place = some.withColumn("__r", F.row_number().over(Window.partitionBy("__b").orderBy("__h", *tie)) - 1)
    hit = F.lit(False)
    for b, r in wanted.values():
        hit = hit | ((F.col("__b") == b) & (F.col("__r") == r))
    got = {(x["__b"], x["__r"]): (x["__h"], *(x[t] for t in tie)) for x in place.where(hit).collect()}
    return [got[wanted[p]] if p in wanted else None for p in ranks]


def comes_before(at: tuple | None, h: Column, *tie: str) -> Column:
    """Whether (h, *tie) is less than the row ``at``; every row is before None."""
    if at is None:
        return F.lit(True)
    out = F.lit(False)
    for c, v in reversed(list(zip([h, *map(F.col, tie)], at, strict=True))):
        out = (c < v) | ((c == v) & out)
    return out
