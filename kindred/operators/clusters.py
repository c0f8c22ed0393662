"""Edges and clusters: edits, selections, purity, sizes, status and export."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kindred.operators.evaluation import harmonic_between, ranked_positives


def canonical(edges: DataFrame) -> DataFrame:
    """(id1, id2), smaller id first, no self loops, no null ends, each edge once."""
    e = edges.where("id1 <> id2")
    return e.select(F.least("id1", "id2").alias("id1"), F.greatest("id1", "id2").alias("id2")).distinct()


def add_edges(edges: DataFrame, more: DataFrame) -> DataFrame:
    return canonical(edges.select("id1", "id2").union(more.select("id1", "id2")))


def remove_edges(edges: DataFrame, gone: DataFrame) -> DataFrame:
    return canonical(edges).join(canonical(gone), ["id1", "id2"], "left_anti")


def induced(edges: DataFrame, members: DataFrame) -> DataFrame:
    """The edges with both ends among the ids of ``members``."""
    for end in ("id1", "id2"):
        edges = edges.join(members.select(F.col("id").alias(end)), end, "left_semi")
    return edges


def edge_status(edges: DataFrame, truth: DataFrame) -> DataFrame:
    """(id1, id2, status): labelled, semi_novel or novel by how many ends have a label; correct where both do."""
    a, b = (truth.select(F.col("id").alias(f"id{k}"), F.col("label").alias(f"l{k}")) for k in (1, 2))
    n = F.col("l1").isNotNull().cast("int") + F.col("l2").isNotNull().cast("int")
    both = edges.join(a, "id1", "left").join(b, "id2", "left")
    return both.select("id1", "id2", F.element_at(F.array(*map(F.lit, ("novel", "semi_novel", "labelled"))), n + 1).alias("status"), (F.col("l1") == F.col("l2")).alias("correct"))


def size_stats(clusters: DataFrame) -> DataFrame:
    """One row of n_clusters, singleton_rate, mean_size, p90_size, p99_size and max_size from (cluster_id, id)."""
    s = clusters.groupBy("cluster_id").agg(F.count("*").alias("size"))
    by = s.groupBy("size").agg(F.count("*").alias("n"))  # quantiles of sizes from how often each occurs
    end = by.select("size", "n", F.sum("n").over(Window.orderBy("size")).alias("end"))  # a row a size
    at = lambda rank: F.min(F.when(F.col("end") > rank, F.col("size")))
    total = by.agg(F.sum("n").alias("total"))
    marks = end.crossJoin(F.broadcast(total))
    spot = {q: F.lit(q) * (F.col("total") - 1) for q in (0.9, 0.99)}
    got = marks.groupBy("total").agg(
        F.sum("n").alias("n_clusters"),
        (F.sum(F.when(F.col("size") == 1, F.col("n")).otherwise(0)) / F.sum("n")).alias("singleton_rate"),
        (F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean_size"),
        *(at(f(spot[q])).alias(f"{name}{int(q * 100)}") for q in spot for f, name in ((F.floor, "lo"), (F.ceil, "hi"))),
        F.max("size").alias("max_size"),
    )
    whole = lambda q: (F.col(f"lo{int(q * 100)}") + (F.col(f"hi{int(q * 100)}") - F.col(f"lo{int(q * 100)}")) * (spot[q] - F.floor(spot[q]))).cast("long")
    return got.select("n_clusters", "singleton_rate", "mean_size", whole(0.9).alias("p90_size"), whole(0.99).alias("p99_size"), "max_size")


def purity(labelled: DataFrame) -> DataFrame:
    """purity (weighted), pure90 (share of clusters) and n_unlabelled from (cluster_id, label), label null if unknown."""
    n = labelled.groupBy("cluster_id", "label").agg(F.count("*").alias("n"))
    known = F.when(F.col("label").isNotNull(), F.col("n"))
    c = n.groupBy("cluster_id").agg(F.max(known).alias("top"), F.sum(known).alias("all"))
    pure = F.col("top") / F.col("all")
    return c.agg((F.sum("top") / F.sum("all")).alias("purity"), F.avg(F.when(pure >= 0.9, 1.0).when(pure.isNotNull(), 0.0)).alias("pure90"), F.count_if(F.col("all").isNull()).alias("n_unlabelled"))


def node_status(labelled: DataFrame) -> DataFrame:
    """(cluster_id, id, status): anchor with the cluster's most common label (the smallest among equals),
    discrepant with another one, new without one."""
    n = labelled.where("label is not null").groupBy("cluster_id", "label").agg(F.count("*").alias("n"))
    top = n.groupBy("cluster_id").agg(F.min_by("label", F.struct(-F.col("n"), "label")).alias("anchor"))
    status = F.when(F.col("label").isNull(), "new").when(F.col("label") == F.col("anchor"), "anchor").otherwise("discrepant")
    return labelled.join(top, "cluster_id", "left").select("cluster_id", "id", status.alias("status"))


def average_precision(scored: DataFrame) -> DataFrame:
    """(ap) from (id, score, label); 0 without positives.

    Of n equal scores that are all positive, after n0 rows with p0 positives, the k-th adds (p0 + k) / (n0 + k).
    """
    groups, mixed = ranked_positives(scored)
    n, n0, p0 = F.col("n"), F.col("n0"), F.col("p0")
    pure = F.when(F.col("p") == n, n + (p0 - n0) * harmonic_between(n0, n0 + n))
    sums = groups.agg(F.sum(pure).alias("s"), F.sum("p").alias("p")).crossJoin(mixed.agg(F.sum(F.col("tp") / F.col("rank")).alias("m")))  # one row each
    return sums.select(F.when(F.col("p") > 0, (F.coalesce("s", F.lit(0.0)) + F.coalesce("m", F.lit(0.0))) / F.col("p")).otherwise(0.0).alias("ap"))


def precision_at(scored: DataFrame, ks: list[int] | None = None) -> DataFrame:
    """(k, precision, recall) from the first max(ks) rows by falling score, then id; without ks, k is the number of positives."""
    if ks is None:
        ks = [max(1, scored.agg(F.sum("label")).first()[0] or 0)]
    top = scored.orderBy(F.col("score").desc(), "id").limit(max(ks)).withColumn("rank", F.row_number().over(Window.orderBy(F.col("score").desc(), "id")))
    total = scored.agg(F.sum("label").alias("pos"), F.count("*").alias("n"))
    cuts = top.crossJoin(F.broadcast(total)).withColumn("k", F.explode(F.array(*map(F.lit, ks)))).where("rank <= k")  # as many copies as there are ks
    got = cuts.groupBy("k").agg(F.sum("label").alias("tp"), F.count("*").alias("m"), F.first("pos").alias("pos"))
    return got.select("k", (F.col("tp") / F.col("m")).alias("precision"), F.when(F.col("pos") > 0, F.col("tp") / F.col("pos")).otherwise(0.0).alias("recall"))


def missing_summary(df: DataFrame) -> DataFrame:
    """(column, n_missing, percent) of the columns with nulls."""
    n = df.agg(F.count("*").alias("__n"), *(F.count_if(F.col(c).isNull()).alias(c) for c in df.columns))
    long = n.select("__n", F.explode(F.map_from_arrays(F.array(*map(F.lit, df.columns)), F.array(*(F.col(c) for c in df.columns)))).alias("column", "n_missing"))
    return long.where("n_missing > 0").select("column", "n_missing", F.round(100 * F.col("n_missing") / F.col("__n"), 2).alias("percent"))
