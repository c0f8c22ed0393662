"""Pair scorers beside the judgment scorer, thresholds and calibration."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.functions.similarity import jaro_winkler
from kindred.functions.text import SOUNDEX_CODES, SOUNDEX_LETTERS, clean, sigmoid
from kindred.operators.ranks import ordered_rank, quantiles
from kindred.plans.stage import staged

UNKNOWN = 0.5
FLOOR = 1e-10


def readied(kind: str, c: Column, **params: float) -> Column:
    """What ``rule`` takes of one value, made once a record; null where it gives no evidence."""
    x = clean(F.lower(c.cast("string")))
    match kind:
        case "prefix":
            n = int(params.get("min_len", 3))
            return F.when(F.length(x) >= n, x.substr(1, n))
        case "numeric_within":
            return x.try_cast("double")
        case "soundex":
            return rule_soundex(x)
        case "jaccard":
            return F.array_distinct(F.split(x, r"\s+"))
    return x


def readied_rule(kind: str, x: Column, y: Column, **params: float) -> Column:
    """``rule`` of two values that ``readied`` has made."""
    match kind:
        case "exact" | "prefix" | "soundex":
            score = F.when(x == y, 1.0).otherwise(0.0)
        case "numeric_within":
            most = params.get("max_diff", 5)
            gap = F.abs(x - y)
            score = F.when(gap <= most, 1 - gap / (most + 1)).otherwise(0.0)
        case "jaccard":
            shared = F.size(F.array_intersect(x, y))
            score = shared / (F.size(x) + F.size(y) - shared)
        case _:
            return F.lit(UNKNOWN)
    return F.when(x.isNull() | y.isNull(), UNKNOWN).otherwise(score)


def rule(kind: str, a: Column, b: Column, **params: float) -> Column:
    """Agreement in [0, 1] of two values; null, blank, unreadable or an unknown kind give 0.5.

    Kinds: exact, prefix (min_len 3), numeric_within (max_diff 5), soundex, jaccard. For many pairs of few records,
    ``readied`` and ``readied_rule`` are its two halves.
    """
    return readied_rule(kind, readied(kind, a, **params), readied(kind, b, **params), **params)


def rule_soundex(x: Column) -> Column:
    """First letter and up to three codes; a code is left out if it equals the last one written."""
    coded = F.translate(F.upper(x), SOUNDEX_LETTERS, SOUNDEX_CODES)
    rest = F.filter(F.split(coded.substr(F.lit(2), F.length(x)), ""), lambda c: c.rlike("^[1-6]$"))
    runs = F.aggregate(rest, F.lit("").cast("string"), lambda out, c: F.when(F.substring(out, -1, 1) == c, out).otherwise(F.concat(out, c)))
    return F.rpad(F.concat(F.upper(x).substr(1, 1), runs).substr(1, 4), 4, "0")


def weighted_rules(rules: Sequence[tuple[Column, float]]) -> Column:
    """Weighted mean of rule scores; no weight at all gives 0.5."""
    total = float(sum(w for _, w in rules))
    if not total:
        return F.lit(UNKNOWN)
    return sum((s * w for s, w in rules[1:]), rules[0][0] * rules[0][1]) / total


#: Fixed values: (field, kind, weight, limits) of the rules for census records.
DEFAULT_RULES = (
    ("nafn_norm", "exact", 3.0, {}),
    ("first_name", "exact", 2.0, {}),
    ("patronym", "exact", 1.5, {}),
    ("surname", "exact", 1.5, {}),
    ("birthyear", "numeric_within", 2.0, {"max_diff": 5}),
    ("sex", "exact", 1.0, {}),
    ("parish", "exact", 0.5, {}),
    ("county", "exact", 0.5, {}),
)


def rules_score(rules: Sequence[tuple] = DEFAULT_RULES) -> Column:
    """The weighted mean of (field, kind, weight, limits) rules over fields suffixed 1 and 2."""
    return weighted_rules([(rule(kind, F.col(f"{f}1"), F.col(f"{f}2"), **limits), w) for f, kind, w, limits in rules])


def agreement(a: Column, b: Column) -> Column:
    """missing, exact_match or mismatch."""
    return readied_agreement(readied("exact", a), readied("exact", b))


def readied_agreement(x: Column, y: Column) -> Column:
    """``agreement`` of two values that ``readied`` has made, as for an exact rule."""
    return F.when(x.isNull() | y.isNull(), "missing").when(x == y, "exact_match").otherwise("mismatch")


def fellegi_sunter_weights(pairs: DataFrame, fields: dict[str, Column]) -> DataFrame:
    """(field, level, m, u, weight) from (label, ...): smoothed level frequencies in either class.

    One aggregation by the levels of all fields together (three to the power of their number at most); only its rows
    are unpivoted.
    """
    seen = pairs.groupBy("label", *(v.alias(f"__{k}") for k, v in fields.items())).agg(F.count("*").alias("n"))
    levels = F.explode(F.array(*(F.struct(F.lit(k).alias("field"), F.col(f"__{k}").alias("level")) for k in fields))).alias("x")
    n = seen.select("label", "n", levels).groupBy("x.field", "x.level").agg(F.sum(F.col("label") * F.col("n")).alias("nm"), F.sum((1 - F.col("label")) * F.col("n")).alias("nu"))
    w = Window.partitionBy("field")
    k = F.count("*").over(w) * 0.1
    m, u = ((F.col(c) + 0.1) / (F.sum(c).over(w) + k) for c in ("nm", "nu"))
    return n.select("field", "level", m.alias("m"), u.alias("u")).withColumn("weight", F.ln(F.greatest("m", F.lit(FLOOR)) / F.greatest("u", F.lit(FLOOR))))


def fellegi_sunter_scores(pairs: DataFrame, fields: dict[str, Column], weights: DataFrame) -> DataFrame:
    """``pairs`` with llr and score. Weights, three rows a field, travel as one map; unseen levels weigh 0."""
    table = weights.agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("|", "field", "level"), "weight"))).alias("w"))
    parts = [F.coalesce(F.element_at("w", F.concat(F.lit(f"{k}|"), v)), F.lit(0.0)) for k, v in fields.items()]
    return pairs.crossJoin(F.broadcast(table)).withColumn("llr", sum(parts[1:], parts[0])).withColumn("score", sigmoid(F.col("llr"))).drop("w")


#: Closeness from which two strings agree, and the bounds of a rate of agreement.
CLOSE = 0.85
RATES = (0.01, 0.99)
DEFAULT_RATES = (0.9, 0.1)


def closeness_flags(fields: dict[str, tuple[Column, Column]], close: float = CLOSE) -> dict[str, Column]:
    """Per field whether the values' Jaro-Winkler similarity is ``close``; a missing value doesn't agree."""
    return {f: F.coalesce(jaro_winkler(a.cast("string"), b.cast("string")) >= close, F.lit(False)) for f, (a, b) in fields.items()}


def equality_flags(fields: dict[str, tuple[Column, Column]]) -> dict[str, Column]:
    """Per field whether the values are equal; a missing value doesn't agree."""
    return {f: F.coalesce(a == b, F.lit(False)) for f, (a, b) in fields.items()}


def agreement_rates(flagged: DataFrame, fields: list[str], weight: str | None = None) -> DataFrame:
    """(field, m, u): rates of agreement among matches and others, kept within RATES, from (label, one boolean a field).

    One aggregation; without pairs of a class its DEFAULT_RATES stand. ``weight``: pairs of a row.
    """
    low, high = RATES
    each = F.lit(1) if weight is None else F.col(weight)
    share = lambda f, k: F.try_divide(F.sum(F.when(F.col("label") == k, F.col(f).cast("int") * each)), F.sum(F.when((F.col("label") == k) & F.col(f).isNotNull(), each)))
    rate = lambda f, k, default: F.greatest(F.lit(low), F.least(F.lit(high), F.coalesce(share(f, k), F.lit(default))))
    one = flagged.agg(*(F.struct(F.lit(f).alias("field"), rate(f, 1, DEFAULT_RATES[0]).alias("m"), rate(f, 0, DEFAULT_RATES[1]).alias("u")).alias(f) for f in fields))
    return one.select(F.explode(F.array(*fields)).alias("x")).select("x.*")


def random_match_rates(records: DataFrame, fields: list[str]) -> DataFrame:
    """(field, u): how often two records drawn at random agree on a field, exactly, from the counts of its values."""
    out = None
    for f in fields:
        n = records.where(F.col(f).isNotNull()).groupBy(f).agg(F.count("*").alias("n"))
        pairs = records.agg((F.count("*") * (F.count("*") - 1) / 2).alias("all"))
        row = n.agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("same")).crossJoin(pairs).select(F.lit(f).alias("field"), F.try_divide(F.coalesce("same", F.lit(0.0)), F.col("all")).alias("u"))
        out = row if out is None else out.union(row)
    return out


def agreement_scores(flagged: DataFrame, rates: DataFrame) -> DataFrame:
    """``flagged`` with llr: ln(m / u) for each field that agrees, ln((1 - m) / (1 - u)) for each other."""
    table = rates.agg(F.map_from_entries(F.collect_list(F.struct("field", F.struct("m", "u")))).alias("w"))  # a row a field
    total = F.lit(0.0)
    for r in rates.select("field").collect():
        x = F.element_at("w", r["field"])
        total = total + F.when(F.col(r["field"]), F.ln(x["m"] / x["u"])).otherwise(F.ln((1 - x["m"]) / (1 - x["u"])))
    return flagged.crossJoin(F.broadcast(table)).withColumn("llr", total).drop("w")


def median_midpoint(scored: DataFrame, default: float = 0.5, weight: str | None = None) -> DataFrame:
    """(threshold): midway between the class medians; one class only: 0.9 or 1.1 times its median."""
    m = quantiles(scored, "score", [0.5], ["label"], weight)
    of = lambda k: F.max(F.when(F.col("label") == k, F.col("x")))
    pos, neg = F.col("pos"), F.col("neg")
    return m.agg(of(1).alias("pos"), of(0).alias("neg")).select(F.coalesce((pos + neg) / 2, pos * 0.9, neg * 1.1, F.lit(default)).alias("threshold"))


def _grid_cell(low: float, high: float, points: int) -> Column:
    """The last point of an even grid that the score reaches."""
    return F.least(F.floor((F.col("score") - low) / ((high - low) / (points - 1)) + 1e-9), F.lit(points - 1))


def f1_grid(scored: DataFrame, low: float = 0.1, high: float = 0.9, points: int = 81, last_best: bool = False, metric: str = "f1", weight: str | None = None) -> DataFrame:
    """(threshold, value): the best of an even grid by f1, precision, recall or accuracy, the first or the last among equals.

    One pass counts scores between grid points; the sums from above go over ``points`` rows. ``weight``: a column
    that says how many pairs a row stands for.
    """
    n = F.lit(1) if weight is None else F.col(weight)
    cell = scored.groupBy(_grid_cell(low, high, points).alias("i")).agg(F.sum(F.col("label") * n).alias("p"), F.sum((1 - F.col("label")) * n).alias("n"))
    return _grid_best(cell, low, high, points, last_best, metric)


def _grid_best(cell: DataFrame, low: float, high: float, points: int, last_best: bool, metric: str) -> DataFrame:
    step = (high - low) / (points - 1)
    grid = cell.sparkSession.range(points).select(F.col("id").alias("i"))
    every = cell.join(grid, "i", "full").na.fill(0)
    above, all_ = Window.orderBy(F.col("i").desc()), Window.partitionBy()
    sums = every.select("i", F.sum("p").over(above).alias("tp"), F.sum("n").over(above).alias("fp"), F.sum("p").over(all_).alias("pos"), F.sum("n").over(all_).alias("neg")).where("i >= 0")
    tp, fp, pos, neg = (F.col(c).cast("double") for c in ("tp", "fp", "pos", "neg"))
    value = {"f1": F.try_divide(2 * tp, tp + fp + pos), "precision": F.try_divide(tp, tp + fp), "recall": F.try_divide(tp, pos), "accuracy": F.try_divide(tp + neg - fp, pos + neg)}[metric]
    order = F.col("i").desc() if last_best else F.col("i")
    named = sums.select((low + F.col("i") * step).alias("threshold"), F.coalesce(value, F.lit(0.0)).alias(metric), "i")
    return named.orderBy(F.round(metric, 12).desc(), order).limit(1).select("threshold", metric)


#: The grids (low, high, points, last among equals) that the models choose a threshold from.
GRIDS = {"judgments": (0.1, 0.9, 81, False), "evaluation": (0.05, 0.95, 181, True), "metric": (0.0, 1.0, 101, False), "embedding": (0.3, 0.9, 25, False)}


def grid_threshold(scored: DataFrame, grid: str, metric: str = "f1", weight: str | None = None) -> DataFrame:
    """The best threshold of one of GRIDS."""
    low, high, points, last = GRIDS[grid]
    return f1_grid(scored, low, high, points, last, metric, weight)


def grid_thresholds(scored: DataFrame, metric: str = "f1") -> DataFrame:
    """(grid, threshold, value): the best threshold of each of GRIDS.

    One pass over the pairs counts them by their cells in all grids together, no more than the grids have points.
    """
    at = [_grid_cell(low, high, points).alias(name) for name, (low, high, points, _) in GRIDS.items()]
    cells = staged(scored.groupBy(*at).agg(F.sum("label").alias("p"), F.sum(1 - F.col("label")).alias("n")), "cells", 1 << 10)
    out = None
    for name, (low, high, points, last) in GRIDS.items():
        cell = cells.groupBy(F.col(name).alias("i")).agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
        row = _grid_best(cell, low, high, points, last, metric).select(F.lit(name).alias("grid"), "threshold", metric)
        out = row if out is None else out.union(row)
    return out


def span_threshold(scored: DataFrame, points: int = 100, weight: str | None = None) -> DataFrame:
    """(threshold, f1): the best of an even grid from the lowest to the highest score, the first among equals."""
    ends = scored.agg(F.min("score"), F.max("score")).first()
    if ends[0] is None or ends[0] == ends[1]:
        return scored.sparkSession.createDataFrame([(0.0 if ends[0] is None else float(ends[0]), 0.0)], "threshold double, f1 double")
    return f1_grid(scored, float(ends[0]), float(ends[1]), points, weight=weight)


def calibrated_predictions(scored: DataFrame, threshold: float = 0.5, column: str = "calibrated") -> DataFrame:
    """``scored`` with prediction: 1 where the calibrated score reaches the threshold."""
    return scored.withColumn("prediction", (F.col(column) >= threshold).cast("int"))


def fixed_threshold(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``scored`` with calibrated, the score itself, and prediction at a threshold that nothing is fitted for."""
    return calibrated_predictions(scored.withColumn("calibrated", F.col("score")), threshold)


#: Fixed values of the sigmoid fit: rounds, weight decay of the slope, share of a Newton step, and where it stops.
PLATT = {"rounds": 50, "ridge": 1e-3, "step": 0.5, "still": 1e-8, "flat": 1e-12, "steepest": 50.0}


def fit_platt(scored: DataFrame, weight: str | None = None) -> tuple[float, float]:
    """(a, b) that make sigmoid(a * score + b) likeliest, by damped Newton steps from a = 0 and the log odds of the labels.

    Each step is one aggregation: with x = (score, 1), the gradient is the sum of (p - label) x and the
    curvature the sum of p (1 - p) x x'. Labels of one class, or none, leave (0, 0). ``weight``: pairs of a row.
    """
    k = F.lit(1) if weight is None else F.col(weight)
    total = scored.agg(F.try_divide(F.sum(F.col("label") * k), F.sum(F.when(F.col("label").isNotNull(), k))).alias("rate"), F.count("*").alias("n")).first()
    if not total["n"] or total["rate"] in (0.0, 1.0):
        return 0.0, 0.0
    theta = np.array([0.0, np.log(total["rate"] / (1 - total["rate"]))])
    x = (F.col("score"), F.lit(1.0))
    decay = np.array([PLATT["ridge"], 0.0])
    for _ in range(PLATT["rounds"]):
        z = F.greatest(F.lit(-PLATT["steepest"]), F.least(F.lit(PLATT["steepest"]), float(theta[0]) * x[0] + float(theta[1])))
        p = sigmoid(z)
        sums = [F.sum((p - F.col("label")) * xi * k) for xi in x] + [F.sum(p * (1 - p) * xi * xj * k) for xi in x for xj in x]
        row = np.array(scored.agg(*sums).first(), float)
        gradient, curvature = row[:2] + decay * theta, row[2:].reshape(2, 2) + PLATT["ridge"] * np.eye(2)
        if np.linalg.det(curvature) <= PLATT["flat"]:
            break
        move = np.linalg.solve(curvature, gradient)
        theta = theta - PLATT["step"] * move
        if np.abs(move).sum() < PLATT["still"]:
            break
    return float(theta[0]), float(theta[1])


def _pool(rows: pd.DataFrame) -> pd.DataFrame:
    """Blocks (x, s, n) in order of x, pooled until their means rise."""
    out: list[list[float]] = []
    for x, s, n in rows.sort_values("x")[["x", "s", "n"]].itertuples(index=False):
        out.append([x, s, n])
        while len(out) > 1 and out[-2][1] * out[-1][2] >= out[-1][1] * out[-2][2]:
            x, s, n = out.pop()
            out[-1] = [x, out[-1][1] + s, out[-1][2] + n]
    return pd.DataFrame(out, columns=["x", "s", "n"])


def fit_isotonic(scored: DataFrame, ranges: int = 256, weight: str | None = None) -> DataFrame:
    """(x, y): right ends and values of the blocks of a rising step function; ties are one point. ``weight``: pairs of a row.

    Pooling may go in any order, so ranges of distinct scores are pooled by themselves first; only
    their blocks meet in one task.
    """
    k = F.lit(1) if weight is None else F.col(weight)
    points = scored.groupBy(F.col("score").cast("double").alias("x")).agg(F.sum(F.col("label") * k).cast("double").alias("s"), F.sum(k).cast("double").alias("n"))
    first = points.groupBy(F.floor(F.col("x") * ranges).alias("part")).applyInPandas(_pool, "x double, s double, n double")
    return first.groupBy().applyInPandas(_pool, "x double, s double, n double").select("x", (F.col("s") / F.col("n")).alias("y"))


#: Blocks that travel as two arrays; more of them meet the scores in a join by range.
FEW_BLOCKS = 1 << 14


def apply_isotonic(scored: DataFrame, blocks: DataFrame, ranges: int = 1024) -> DataFrame:
    """``scored`` with calibrated: a score takes the first block whose right end lies above it, else the last.

    Few blocks fold into the rows; otherwise each block covers the ranges of scores it meets, and a score
    finds it by an equal range.
    """
    few = blocks.orderBy("x").limit(FEW_BLOCKS + 1).collect()
    if not few:
        return scored.withColumn("calibrated", F.col("score"))
    if len(few) <= FEW_BLOCKS:
        x, y = [float(b["x"]) for b in few], [float(b["y"]) for b in few]

        @F.pandas_udf("double")
        def look_up(s: pd.Series) -> pd.Series:
            return pd.Series(np.array(y)[np.minimum(np.searchsorted(x, s.to_numpy(), side="right"), len(y) - 1)])

        return scored.withColumn("calibrated", look_up("score"))
    rank = ordered_rank(blocks, "x", name="i")
    before = rank.select((F.col("i") + 1).alias("i"), F.col("x").alias("__from"))
    cut = lambda c: F.floor(F.greatest(F.lit(-1e9), F.least(F.lit(1e9), c)) * ranges)
    last = rank.agg(F.max("x").alias("__top"), F.max_by("y", "x").alias("__last"))
    spans = rank.join(before, "i", "left").select("__from", F.col("x").alias("__to"), F.col("y").alias("__y"))
    spans = spans.withColumn("__from", F.coalesce("__from", F.col("__to") - 1e-9)).withColumn("__b", F.explode(F.sequence(cut(F.col("__from")), cut(F.col("__to")))))
    low = rank.agg(F.min("x").alias("__low"), F.min_by("y", "x").alias("__first"))
    rows = scored.crossJoin(F.broadcast(last)).crossJoin(F.broadcast(low)).withColumn("__k", F.monotonically_increasing_id())
    found = rows.withColumn("__b", cut(F.col("score"))).join(spans, "__b", "left").where("__y is null or (score >= __from and score < __to) or score < __low or score >= __top")
    value = F.when(F.col("score") >= F.col("__top"), F.col("__last")).when(F.col("score") < F.col("__low"), F.col("__first")).otherwise(F.col("__y"))
    return found.withColumn("calibrated", value).dropDuplicates(["__k"]).drop("__b", "__from", "__to", "__y", "__top", "__last", "__low", "__first", "__k")
