import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred.operators import graph

EDGES = [(1, 2, 0.9), (1, 3, 0.8), (2, 3, 0.85), (4, 5, 0.95), (4, 6, 0.7)]


def frame(spark, edges):
    return spark.createDataFrame(edges, "id1 long, id2 long, score double")


def groups(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.cluster_id, set()).add(r.id)
    return sorted(map(sorted, out.values()))


def test_fixture(spark):
    edges, nodes = frame(spark, EDGES), spark.range(1, 8)
    assert groups(graph.hierarchical_clusters(edges, nodes, 0.3)) == [[1, 2, 3], [4, 5], [6], [7]]
    assert groups(graph.thresholded_components(edges, nodes, 0.7)) == [[1, 2, 3], [4, 5, 6], [7]]
    low = {r.id: r.cluster_id for r in graph.thresholded_components(edges, nodes, 0.7, isolated=-1).collect()}
    assert low == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 4, 7: -1}
    assert groups(graph.hierarchical_clusters(edges.where("false"), nodes)) == [[i] for i in range(1, 8)]
    with pytest.raises(ValueError):
        graph.hierarchical_clusters(edges, nodes, 1.0)


def plain(n, edges, threshold, linkage):
    dist = np.ones((n, n))
    for a, b, s in edges:
        dist[a, b] = dist[b, a] = round(1 - s, 12)
    clusters = [[i] for i in range(n)]
    of = {"average": np.mean, "single": np.min, "complete": np.max}[linkage]
    while True:
        best = None
        for x in range(len(clusters)):
            for y in range(x + 1, len(clusters)):
                d = of(dist[np.ix_(clusters[x], clusters[y])])
                if best is None or d < best[0] - 1e-12:
                    best = (d, x, y)
        if best is None or best[0] > threshold:
            return sorted(map(sorted, clusters))
        clusters[best[1]] += clusters.pop(best[2])


@pytest.mark.parametrize("linkage", ["average", "single", "complete"])
def test_linkages(spark, linkage):
    rng = random.Random(4)
    pairs = {(a, b) for a, b in ((rng.randrange(30), rng.randrange(30)) for _ in range(90)) if a < b}
    edges = [(a, b, rng.random()) for a, b in sorted(pairs)]
    got = groups(graph.hierarchical_clusters(frame(spark, edges), spark.range(30), 0.45, linkage))
    assert got == plain(30, edges, 0.45, linkage)


def test_large_components_are_refused(spark, monkeypatch):
    monkeypatch.setattr(graph, "LARGEST", 2)
    with pytest.raises(ValueError, match="at most"):
        graph.hierarchical_clusters(frame(spark, EDGES), spark.range(1, 8), 0.3)


def people(spark):
    rows = [(1, None, None, 2), (2, None, None, 1), (3, 1, 2, None), (4, 1, 2, 4), (5, 3, 3, None), (6, 99, None, None)]
    return spark.createDataFrame(rows, "id long, father long, mother long, partner long")


def test_family(spark):
    p = people(spark)
    kin = {tuple(r) for r in graph.kin_edges(p).collect()}
    assert kin == {(1, 3, "father"), (2, 3, "mother"), (1, 4, "father"), (2, 4, "mother"), (3, 5, "father"), (3, 5, "mother"), (1, 2, "partner"), (2, 1, "partner"), (4, 4, "partner")}
    near = {r.id: r.depth for r in graph.family_members(p, p.where("id = 5"), 2).collect()}
    assert near == {5: 0, 3: 1, 1: 2, 2: 2}
    assert graph.family_members(p, p.where("id = 5"), 9, most=3).count() == 3
    edges = {tuple(r) for r in graph.family_edges(p, graph.family_members(p, p.where("id = 5"), 1), 1).collect()}
    assert edges == {(3, 5, "father"), (3, 5, "mother")}
    assert {r.id: r.issues for r in graph.quality_flags(p).collect()} == {4: "self_partner", 5: "same_parent_id_in_both_columns"}
    index = {r.id: (r.father_of, r.mother_of) for r in graph.kin_index(p).collect()}
    assert index[1] == ([3, 4], []) and index[3] == ([5], [5])


def test_views(spark):
    e = spark.createDataFrame([(1, 2), (1, 3), (1, 4), (2, 3), (5, 6)], "id1 long, id2 long")
    assert graph.pruned_edges(e, 10, 3).count() == 5
    assert sorted(map(tuple, graph.pruned_edges(e, 3, 3).collect())) == [(1, 2), (1, 3), (2, 3)]
    nodes = spark.createDataFrame([(1, "b"), (2, None), (3, "a")], "id long, person string")
    assert {r.id: (r.grp, r.band) for r in graph.node_groups(nodes, "person").collect()} == {1: ("b", 2), 2: ("Unknown", 0), 3: ("a", 1)}
    assert {r.id: r.grp for r in graph.node_groups(nodes, "person", F.lit("b")).collect()} == {1: "Anchor", 2: "New", 3: "Discrepant"}
    marks = spark.createDataFrame([(7, 2, 1, "wrong", 1), (7, 1, 2, "right", 2), (7, 3, 4, "wrong", 1)], "cluster_id long, id1 long, id2 long, status string, at long")
    sent = graph.feedback_json(marks)
    assert {(r.edge, r.status) for r in graph.feedback_from_json(sent).collect()} == {("1_2", "right"), ("3_4", "wrong")}
    wide = spark.createDataFrame([(1, [4, 5]), (2, [6])], "cluster_id long, members array<long>")
    assert [tuple(r) for r in graph.cluster_of(wide, spark.createDataFrame([(5,), (9,)], "id long")).collect()] == [(5, 1, 2)]
