"""Pair scoring by judgments: symbolic outcomes of comparisons, weighed by log likelihood ratios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.functions.text import clip, sigmoid

LIMIT = 5.0
#: Weights that travel as one broadcast map; more of them meet the pairs in a join.
MAPPED = 4096


def same_or_different(name: str, a: Column, b: Column) -> Column:
    """same_<name>, different_<name>, or nothing where a value is missing."""
    return F.when(a.isNull() | b.isNull(), None).when(a == b, f"same_{name}").otherwise(f"different_{name}")


def judgment_weights(judged: DataFrame) -> DataFrame:
    """(judgment, n_match, n_non, weight) from (label, judgments): smoothed and clipped log ratios.

    One aggregation; totals are two numbers that join it as a broadcast of one row. Where one class is
    absent every weight is 0.
    """
    counted = judged.select("label", F.explode("judgments").alias("judgment")).groupBy("judgment").agg(F.sum("label").alias("n_match"), F.sum(1 - F.col("label")).alias("n_non"))
    total = judged.agg(F.sum("label").alias("m"), F.sum(1 - F.col("label")).alias("n"))
    ratio = F.ln(((F.col("n_match") + 1) / (F.col("m") + 2)) / ((F.col("n_non") + 1) / (F.col("n") + 2)))
    weight = F.when((F.col("m") > 0) & (F.col("n") > 0), clip(ratio, -LIMIT, LIMIT)).otherwise(0.0)
    return counted.crossJoin(F.broadcast(total)).select("judgment", "n_match", "n_non", weight.alias("weight"))


def prior_log_odds(labelled: DataFrame) -> DataFrame:
    """(prior): log odds of the labels; 0 where one class is absent."""
    total = labelled.agg(F.sum("label").alias("m"), F.sum(1 - F.col("label")).alias("n"))
    return total.select(F.when((F.col("m") > 0) & (F.col("n") > 0), F.ln(F.try_divide(F.col("m").cast("double"), F.col("n").cast("double")))).otherwise(0.0).alias("prior"))


def judgment_scores(judged: DataFrame, weights: DataFrame, prior: DataFrame) -> DataFrame:
    """(id1, id2, label, score): logistic of the summed weights and the prior log odds; no judgments: 0.5.

    ``judged`` may lack label, which is null then. Up to MAPPED weights fold over the arrays as one map, so
    no pair moves; more (judgments that hold words) are joined.
    """
    if "label" not in judged.columns:
        judged = judged.withColumn("label", F.lit(None).cast("int"))
    few = weights.select("judgment", "weight").limit(MAPPED + 1).collect()  # MAPPED + 1 rows at most
    odds = F.broadcast(prior_log_odds(prior))
    if len(few) <= MAPPED:
        entries = F.from_json(F.lit(_json(few)), "map<string,double>")
        total = F.aggregate("judgments", F.lit(0.0), lambda acc, j: acc + F.coalesce(F.element_at(entries, j), F.lit(0.0)))
        rows = judged.select("id1", "id2", "label", total.alias("total"), F.size("judgments").alias("n"))
    else:
        each = judged.select("id1", "id2", "label", F.explode_outer("judgments").alias("judgment")).join(weights.select("judgment", "weight"), "judgment", "left")
        rows = each.groupBy("id1", "id2", "label").agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("total"), F.count("judgment").alias("n"))
    return rows.crossJoin(odds).select("id1", "id2", "label", F.when(F.col("n") == 0, 0.5).otherwise(sigmoid(F.col("total") + F.col("prior"))).alias("score"))


def _json(rows) -> str:
    import json

    return json.dumps({r["judgment"]: r["weight"] for r in rows})


def explain_weights(judged: DataFrame) -> DataFrame:
    """(judgment, weight, n_match, n_non, match_rate, non_match_rate, place): the strongest weight first."""
    total = judged.agg(F.greatest(F.sum("label"), F.lit(1)).alias("m"), F.greatest(F.sum(1 - F.col("label")), F.lit(1)).alias("n"))
    w = judgment_weights(judged).crossJoin(F.broadcast(total))
    place = F.row_number().over(Window.orderBy(F.round(F.abs("weight"), 9).desc(), "judgment"))  # as many rows as judgments
    return w.select("judgment", "weight", "n_match", "n_non", (F.col("n_match") / F.col("m")).alias("match_rate"), (F.col("n_non") / F.col("n")).alias("non_match_rate"), place.cast("long").alias("place"))


def explain_pairs(judged: DataFrame, weights: DataFrame) -> DataFrame:
    """(id1, id2, judgment, weight): what each judgment adds to a pair's log odds."""
    each = judged.select("id1", "id2", F.explode("judgments").alias("judgment"))
    return each.join(weights.select("judgment", "weight"), "judgment", "left").select("id1", "id2", "judgment", F.coalesce("weight", F.lit(0.0)).alias("weight"))


def exemplars(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(outcome, id1, id2, score): of each of tp, tn, fp and fn the pair with the smallest ids."""
    hit = F.col("score") >= threshold
    outcome = F.when(hit, F.when(F.col("label") == 1, "tp").otherwise("fp")).otherwise(F.when(F.col("label") == 1, "fn").otherwise("tn"))
    first = scored.groupBy(outcome.alias("outcome")).agg(F.min(F.struct("id1", "id2", "score")).alias("x"))
    return first.select("outcome", "x.*")


def without_judgments(judged: DataFrame, prefixes: list[str]) -> DataFrame:
    """``judged`` without the judgments that hold one of the names (an ablation)."""
    keep = lambda j: ~F.exists(F.array(*map(F.lit, prefixes)), lambda p: j.contains(p)) if prefixes else F.lit(True)
    return judged.withColumn("judgments", F.filter("judgments", keep))


def confusion(scored: DataFrame, threshold: float | Column = 0.5, weight: str | None = None) -> DataFrame:
    """tp, fp, fn, tn, precision, recall, f1 and accuracy in one pass; a ratio over nothing is 0. ``weight``: pairs of a row."""
    each = F.lit(1) if weight is None else F.col(weight)
    hit = F.col("score") >= threshold
    pos = F.col("label") == 1
    n = scored.agg(*(F.coalesce(F.sum(F.when(c, each).otherwise(0)), F.lit(0)).alias(k) for k, c in (("tp", hit & pos), ("fp", hit & ~pos), ("fn", ~hit & pos), ("tn", ~hit & ~pos))))
    return n.select("tp", "fp", "fn", "tn", *rates())


def rates() -> list[Column]:
    """precision, recall, f1 and accuracy of columns tp, fp, fn and tn."""
    over = lambda a, b: F.when(b > 0, F.try_divide(a.cast("double"), b.cast("double"))).otherwise(0.0)
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return [over(tp, tp + fp).alias("precision"), over(tp, tp + fn).alias("recall"), over(2 * tp, 2 * tp + fp + fn).alias("f1"), over(tp + tn, tp + fp + fn + tn).alias("accuracy")]


def ablation(judged: DataFrame, families: dict[str, list[str]], threshold: float = 0.5) -> DataFrame:
    """(variant, f1, delta): the full model and, for each family, the model without its judgments; delta to the full one."""
    out = None
    for name, prefixes in {"full": [], **families}.items():
        some = without_judgments(judged, prefixes)
        row = confusion(judgment_scores(some, judgment_weights(some), some), threshold).select(F.lit(name).alias("variant"), "f1")
        out = row if out is None else out.union(row)
    full = F.max(F.when(F.col("variant") == "full", F.col("f1"))).over(Window.partitionBy())  # a row a variant
    return out.select("variant", "f1", (F.col("f1") - full).alias("delta"))
