import random

import pytest
from pyspark.sql import functions as F

from kindred.operators import clusters, linkage

VALIDATION = [(0.1, 0), (0.2, 0), (0.3, 0), (0.6, 1), (0.7, 1), (0.8, 1), (0.9, 1)]


def scores(spark, rows):
    return spark.createDataFrame(rows, "score double, label int")


def test_platt(spark):
    a, b = linkage.fit_platt(scores(spark, VALIDATION).cache())
    assert (round(a, 6), round(b, 6)) == (19.590586, -8.814445)
    assert linkage.fit_platt(scores(spark, [])) == (0.0, 0.0)


def test_isotonic(spark):
    blocks = linkage.fit_isotonic(scores(spark, VALIDATION))
    new = spark.createDataFrame([(0.4,), (0.5,), (0.75,), (0.05,), (2.0,)], "score double")
    assert [r.calibrated for r in linkage.apply_isotonic(new, blocks).collect()] == [1.0, 1.0, 1.0, 0.0, 1.0]
    assert linkage.fit_isotonic(scores(spark, [])).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_isotonic_brute_force(spark, seed):
    r = random.Random(seed)
    rows = [(r.randrange(40) / 40, r.randrange(2)) for _ in range(200)]
    points = {}
    for x, y in rows:
        s, n = points.get(x, (0, 0))
        points[x] = (s + y, n + 1)
    xs = sorted(points)
    mean = lambda i, j: sum(points[x][0] for x in xs[i : j + 1]) / sum(points[x][1] for x in xs[i : j + 1])
    want = {x: max(min(mean(j, k) for k in range(i, len(xs))) for j in range(i + 1)) for i, x in enumerate(xs)}
    got = sorted(tuple(b) for b in linkage.fit_isotonic(scores(spark, rows), ranges=7).collect())
    for x in xs:
        assert next(y for edge, y in got if edge >= x) == pytest.approx(want[x])


def test_thresholds(spark):
    s = scores(spark, VALIDATION)
    assert linkage.median_midpoint(s).first().threshold == pytest.approx(0.475)
    assert linkage.median_midpoint(s.where("label = 1")).first().threshold == pytest.approx(0.675)
    assert linkage.median_midpoint(s.where("false")).first().threshold == 0.5
    best = linkage.f1_grid(s).first()
    assert (round(best.threshold, 6), best.f1) == (0.31, 1.0)
    assert round(linkage.f1_grid(s, last_best=True).first().threshold, 6) == 0.6


def test_rules(spark):
    lit = lambda x: F.lit(x).cast("string")
    cases = [
        ("exact", " Ann", "ann", 1.0), ("exact", None, "x", 0.5), ("exact", "  ", "x", 0.5), ("prefix", "jonas", "jonah", 1.0), ("prefix", "jo", "jonah", 0.5),
        ("numeric_within", "10", "13", 0.5), ("numeric_within", "10", "16", 0.0), ("numeric_within", "ten", "10", 0.5), ("jaccard", "a b c", "b c d", 0.5), ("soundex", "robert", "rupert", 1.0), ("soundex", "anna", "olaf", 0.0), ("odd", "a", "a", 0.5),
    ]
    got = spark.range(1).select(*(linkage.rule(k, lit(a), lit(b)).alias(f"c{i}") for i, (k, a, b, _) in enumerate(cases))).first()
    assert list(got) == [w for *_, w in cases]


def test_rule_soundex(spark):
    known = {"robert": "R163", "ashcraft": "A261", "tymczak": "T520", "lloyd": "L430", "a": "A000", "jónsson": "J525"}
    got = spark.createDataFrame([(w,) for w in known], "w string").select("w", linkage.rule_soundex(F.col("w")).alias("c")).collect()
    assert {r.w: r.c for r in got} == known


def test_ranking(spark):
    rows = spark.createDataFrame([(i, 1 - i % 2, 0.9 - 0.1 * i) for i in range(8)], "id long, label int, score double")
    assert round(clusters.average_precision(rows).first().ap, 6) == 0.709524
    got = {r.k: (r.precision, r.recall) for r in clusters.precision_at(rows, [3, 5, 50]).collect()}
    assert got == {3: (pytest.approx(2 / 3), 0.5), 5: (0.6, 0.75), 50: (0.5, 1.0)}
    assert clusters.average_precision(rows.where("label = 0")).first().ap == 0.0


def test_edges(spark):
    e = spark.createDataFrame([(2, 1), (1, 2), (3, 3), (2, 3), (None, 4)], "id1 long, id2 long")
    got = lambda df: sorted(map(tuple, df.select("id1", "id2").collect()))
    assert got(clusters.canonical(e)) == [(1, 2), (2, 3)]
    assert got(clusters.remove_edges(e, e.where("id1 = 2 and id2 = 1"))) == [(2, 3)]
    assert got(clusters.add_edges(e, spark.createDataFrame([(9, 1), (1, 2)], "id1 long, id2 long"))) == [(1, 2), (1, 9), (2, 3)]
    assert got(clusters.induced(clusters.canonical(e), spark.createDataFrame([(1,), (2,)], "id long"))) == [(1, 2)]


def test_clusters(spark):
    rows = spark.createDataFrame([(1, 1, 7), (1, 2, 7), (1, 3, 8), (2, 4, None), (3, 5, 9), (3, 6, 4)], "cluster_id int, id int, label int")
    p = clusters.purity(rows).first()
    assert (p.purity, p.pure90, p.n_unlabelled) == (pytest.approx(3 / 5), 0.0, 1)
    assert {r.id: r.status for r in clusters.node_status(rows).collect()} == {1: "anchor", 2: "anchor", 3: "discrepant", 4: "new", 5: "discrepant", 6: "anchor"}
    s = clusters.size_stats(rows).first()
    assert (s.n_clusters, s.singleton_rate, s.mean_size, s.max_size) == (3, pytest.approx(1 / 3), 2.0, 3)
    assert [tuple(r) for r in clusters.missing_summary(rows).collect()] == [("label", 1, 16.67)]
