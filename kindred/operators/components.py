"""Connected components by alternating large-star and small-star rounds.

Every round is two aggregations and two joins on narrow (long, long) rows, so nothing is gathered
anywhere: the minimum of a neighbourhood is a map-side combined aggregate, and a hub's edges meet its
minimum in a plain equi-join, whose large partitions adaptive execution can split. Edges of the
result are a star per component; the number of rounds grows with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.plans.stage import Stages, release, staged


def _mark(edges: DataFrame) -> tuple:
    """Equal marks: the same set of edges."""
    row = edges.agg(
        F.count("*").alias("n"),
        F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"),
    ).first()
    return row["n"], row["h"]


def star_forest(edges: DataFrame, left: str, right: str, max_rounds: int = 60) -> DataFrame:
    """(u, v) with one row per node u that is not its component's minimum v."""
    a, b = F.col(left), F.col(right)
    e = edges.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    e = staged(e, "edges")
    before = _mark(e)
    if before[0] == 0:
        return e
    for _ in range(max_rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low2, "u")
            .select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("x"))
            .select(F.col("x.u").alias("u"), F.col("x.m").alias("v"))
            .where(F.col("u") != F.col("v"))
            .distinct()
        )
        before_round, e = e, staged(small, "edges", 2 * before[0])
        release(before_round)
        now = _mark(e)
        if now == before:
            return e
        before = now
    raise RuntimeError(f"connected components did not settle in {max_rounds} rounds")


def connected_components(edges: DataFrame, left: str = "id1", right: str = "id2", nodes: DataFrame | None = None, node: str = "id", stages: Stages | None = None) -> DataFrame:
    """(id, component_id): the smallest id that each node reaches over the edges.

    Rows with a null end and self loops are ignored as edges. ``nodes`` adds isolated nodes, each its
    own component; without it the result covers the ends of proper edges. ``stages`` takes over the
    table that the result reads.
    """
    star = star_forest(edges, left, right)
    if stages is not None:
        stages.tables.append(star)
    labelled = star.select(F.col("u").alias("id"), F.col("v").alias("component_id"))
    roots = star.select(F.col("v").alias("id"), F.col("v").alias("component_id")).distinct()
    found = labelled.union(roots)
    if nodes is None:
        return found
    every = nodes.select(F.col(node).alias("id")).where(F.col("id").isNotNull()).distinct()
    return every.join(found, "id", "left").select("id", F.coalesce("component_id", "id").alias("component_id"))
