"""Clusterings of scored edges, and views of the record and family graphs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.functions.text import clean, edge_key
from kindred.operators.clusters import canonical, induced
from kindred.operators.components import connected_components
from kindred.operators.evaluation import degree_top_k
from kindred.plans.stage import staged

#: Records of one component that hierarchical clustering takes; its distance matrix is their square.
LARGEST = 4000


def thresholded_components(edges: DataFrame, nodes: DataFrame, threshold: float | None = None, isolated: int | None = None) -> DataFrame:
    """(id, cluster_id): components over the edges with score >= threshold, by their smallest id.

    Nodes of no kept edge are clusters of their own, or get ``isolated`` (such as -1).
    """
    kept = edges if threshold is None else edges.where(F.col("score") >= threshold)
    if isolated is None:
        return connected_components(kept, nodes=nodes).withColumnRenamed("component_id", "cluster_id")
    found = connected_components(kept).withColumnRenamed("component_id", "cluster_id")
    return nodes.select("id").distinct().join(found, "id", "left").select("id", F.coalesce("cluster_id", F.lit(isolated).cast("long")).alias("cluster_id"))


def _merge(n: int, dist: np.ndarray, threshold: float, linkage: str) -> list[int]:
    """The cluster number of each of n points, merging the nearest two (first by index among equals) up to the threshold."""
    dist = dist.copy()
    np.fill_diagonal(dist, np.inf)
    size, label, alive = np.ones(n), np.arange(n), np.ones(n, bool)
    for _ in range(n - 1):
        i, j = np.unravel_index(np.argmin(np.where(np.triu(np.ones_like(dist, bool), 1), dist, np.inf)), dist.shape)
        if not dist[i, j] <= threshold:
            break
        if linkage == "average":
            row = (size[i] * dist[i] + size[j] * dist[j]) / (size[i] + size[j])
        else:
            row = np.minimum(dist[i], dist[j]) if linkage == "single" else np.maximum(dist[i], dist[j])
        dist[i], dist[:, i] = row, row
        dist[j], dist[:, j] = np.inf, np.inf
        dist[i, i] = np.inf
        size[i] += size[j]
        alive[j] = False
        label[label == j] = i
    return label.tolist()


def hierarchical_clusters(edges: DataFrame, nodes: DataFrame, threshold: float = 0.5, linkage: str = "average") -> DataFrame:
    """(id, cluster_id): agglomerative clusters of (id1, id2, score) at distance 1 - score, 1 between the unlinked.

    Two clusters merge at no more than ``threshold`` (below 1) only if some edge between them is that short, so
    clusters lie within the components over such edges, and each component is one task's. Single linkage is those
    components themselves. The other linkages refuse components beyond LARGEST with an error. cluster_id
    is the smallest member; edges of score beyond [0, 1], self loops and nulls are left out; of repeated
    edges the best counts.
    """
    if not 0 <= threshold < 1:
        raise ValueError("the threshold must be from 0 to below 1")
    ends = edges.where("id1 <> id2 and score between 0 and 1").select(F.least("id1", "id2").alias("id1"), F.greatest("id1", "id2").alias("id2"), "score")
    best = staged(ends.groupBy("id1", "id2").agg(F.max("score").alias("score")), "edges")
    short = best.where(F.round(1 - F.col("score"), 12) <= threshold)
    comps = connected_components(short)
    if linkage == "single":
        return nodes.select("id").distinct().join(comps, "id", "left").select("id", F.coalesce("component_id", "id").alias("cluster_id"))
    comps = staged(comps, "components")
    largest = comps.groupBy("component_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    if largest > LARGEST:
        raise ValueError(f"a component of {largest} records; {LARGEST} at most (raise the threshold on scores first)")
    a, b = (comps.select(F.col("id").alias(f"id{k}"), F.col("component_id").alias(f"c{k}")) for k in (1, 2))
    inside = best.join(a, "id1").join(b, "id2").where("c1 = c2").select(F.col("c1").alias("c"), "id1", "id2", "score")

    def cluster(part: pd.DataFrame) -> pd.DataFrame:
        ids = np.unique(np.concatenate([part["id1"], part["id2"]]))
        dist = np.ones((len(ids), len(ids)))
        i, j = np.searchsorted(ids, part["id1"]), np.searchsorted(ids, part["id2"])
        dist[i, j] = dist[j, i] = np.round(1 - part["score"].to_numpy(), 12)
        label = _merge(len(ids), dist, threshold, linkage)
        return pd.DataFrame({"id": ids, "cluster_id": ids[label]})

    found = inside.groupBy("c").applyInPandas(cluster, "id long, cluster_id long")
    return nodes.select("id").distinct().join(found, "id", "left").select("id", F.coalesce("cluster_id", "id").alias("cluster_id"))


def truth_clusters(labelled: DataFrame) -> DataFrame:
    """(id, cluster): components over the pairs with label 1."""
    return connected_components(labelled.where("label = 1")).withColumnRenamed("component_id", "cluster")


def pairs_clusters(scored: DataFrame, threshold: float, linkage: str | None = None) -> DataFrame:
    """(id, cluster_id) of the records that some pair with score >= threshold touches; components, or a linkage."""
    kept = scored.where(F.col("score") >= threshold)
    nodes = kept.select(F.col("id1").alias("id")).union(kept.select("id2")).distinct()
    return thresholded_components(kept, nodes) if linkage is None else hierarchical_clusters(kept, nodes, 1 - threshold, linkage)


def pruned_edges(edges: DataFrame, limit: int, keep: int) -> DataFrame:
    """The edges, or beyond ``limit`` nodes those among the ``keep`` nodes of highest degree."""
    e = canonical(edges)
    nodes = e.select(F.col("id1").alias("id")).union(e.select("id2")).distinct()
    if nodes.count() <= limit:
        return e
    return induced(e, degree_top_k(e, keep).select("id")).select("id1", "id2")


RELATIONS = ("father", "mother")


def kin_edges(people: DataFrame) -> DataFrame:
    """(src, dst, rel): parent to child by father and mother, partners both ways; both ends are people, no null ends."""
    ids = people.select("id")
    known = lambda df, end: df.join(ids.select(F.col("id").alias(end)), end, "left_semi")
    out = people.select(F.col("partner").alias("src"), F.col("id").alias("dst"), F.lit("partner").alias("rel"))
    out = out.union(people.select("id", "partner", F.lit("partner")))
    for rel in RELATIONS:
        out = out.union(people.select(rel, "id", F.lit(rel)))
    return known(known(out.where("src is not null and dst is not null"), "src"), "dst").select("src", "dst", "rel").distinct()


def kin_index(people: DataFrame) -> DataFrame:
    """(id, father_of, mother_of, partner): sorted arrays of children by role (empty for none), and the partner."""
    out = people.select("id", "partner")
    for rel in RELATIONS:
        kids = people.where(F.col(rel).isNotNull()).groupBy(F.col(rel).alias("id")).agg(F.sort_array(F.collect_list(people["id"])).alias(f"{rel}_of"))
        out = out.join(kids, "id", "left").withColumn(f"{rel}_of", F.coalesce(f"{rel}_of", F.array().cast("array<long>")))
    return out.select("id", "father_of", "mother_of", "partner")


def family_members(people: DataFrame, seeds: DataFrame, depth: int = 2, most: int = 150, most_children: int = 50) -> DataFrame:
    """(id, depth): people within ``depth`` steps over parents, children and partners of the seeds.

    One join per step on a frontier of ``most`` rows at most; in a step, smaller ids come first. A person leads to
    ``most_children`` children by each role, the first by id. Seeds need not be people.
    """
    kin = kin_edges(people)
    child = kin.where("rel <> 'partner'").select(F.col("src").alias("id"), F.col("dst").alias("to"), "rel")
    child = child.withColumn("r", F.row_number().over(Window.partitionBy("id", "rel").orderBy("to"))).where(F.col("r") <= most_children).select("id", "to")
    parent = kin.where("rel <> 'partner'").select(F.col("dst").alias("id"), F.col("src").alias("to"))
    step = staged(child.union(parent).union(kin.where("rel = 'partner'").select("src", "dst")).distinct(), "kin")
    known = seeds.select("id").distinct().orderBy("id").limit(most).withColumn("depth", F.lit(0))
    known = staged(known, "family")
    for d in range(1, depth + 1):
        room = most - known.count()
        if room <= 0:
            break
        ahead = known.where(F.col("depth") == d - 1).join(step, "id").select(F.col("to").alias("id")).distinct().join(known, "id", "left_anti")
        known = staged(known.union(ahead.orderBy("id").limit(room).withColumn("depth", F.lit(d))), "family")
    return known


def family_edges(people: DataFrame, members: DataFrame, depth: int = 2) -> DataFrame:
    """(src, dst, rel): the kin edges of the members that were walked on from (of less than ``depth`` steps)."""
    kin = kin_edges(people)
    walked = members.where(F.col("depth") < depth).select("id")
    ends = [kin.join(walked.select(F.col("id").alias(end)), end, "left_semi").select("src", "dst", "rel") for end in ("src", "dst")]
    return ends[0].union(ends[1]).distinct()


def quality_flags(people: DataFrame) -> DataFrame:
    """(id, issues): self_partner, and same_parent_id_in_both_columns; people without any are left out."""
    flags = F.array_compact(F.array(F.when(F.col("father") == F.col("mother"), "same_parent_id_in_both_columns"), F.when(F.col("partner") == F.col("id"), "self_partner")))
    return people.select("id", F.array_join(flags, ", ").alias("issues")).where("issues <> ''")


def node_groups(people: DataFrame, by: str, anchor: Column | None = None) -> DataFrame:
    """(id, grp, band): the group of each node by a column, or by status against the anchor label; bands number the
    groups in order from 0, nodes without a value are Unknown."""
    if anchor is not None:
        grp = F.when(F.col(by).isNull(), "New").when(F.col(by) == anchor, "Anchor").otherwise("Discrepant")
    else:
        grp = F.coalesce(clean(F.col(by).cast("string")), F.lit("Unknown"))
    nodes = people.select("id", grp.alias("grp"))
    bands = nodes.select("grp").distinct().withColumn("band", (F.row_number().over(Window.orderBy("grp")) - 1).cast("long"))  # a row a group
    return nodes.join(bands, "grp").select("id", "grp", "band")


def cluster_of(clusters: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, cluster_id, size) of the clusters (cluster_id, members) that hold the ids."""
    each = clusters.select("cluster_id", F.size("members").cast("long").alias("size"), F.explode("members").alias("id"))
    return each.join(ids.select("id").distinct(), "id", "left_semi").select("id", "cluster_id", "size")


def feedback(marks: DataFrame) -> DataFrame:
    """(cluster_id, edge, status, at): the last status given to each edge of a cluster, from (cluster_id, id1, id2, status, at)."""
    rows = marks.select("cluster_id", edge_key(F.col("id1"), F.col("id2")).alias("edge"), "status", "at")
    return rows.groupBy("cluster_id", "edge").agg(F.max(F.struct("at", "status")).alias("x")).select("cluster_id", "edge", "x.status", "x.at")


def feedback_summary(marks: DataFrame) -> DataFrame:
    """(cluster_id, status, n): edges by their last status."""
    return feedback(marks).groupBy("cluster_id", "status").agg(F.count("*").alias("n"))


def feedback_json(marks: DataFrame) -> DataFrame:
    """(cluster_id, json): the last statuses of a cluster's edges as one JSON object, edges in order."""
    pairs = F.sort_array(F.collect_list(F.struct("edge", "status")))
    return feedback(marks).groupBy("cluster_id").agg(F.to_json(F.map_from_entries(pairs)).alias("json"))


def feedback_from_json(exported: DataFrame) -> DataFrame:
    """(cluster_id, edge, status) of ``feedback_json``."""
    return exported.select("cluster_id", F.explode(F.from_json("json", "map<string,string>")).alias("edge", "status"))
