import itertools
import math

import pytest
from pyspark.sql import functions as F

from kindred.operators import blocking, evaluation, judgments, linkage, models, pairs, scoring, truth


def judged(spark, rows):
    return spark.createDataFrame(rows, "id1 long, id2 long, label int, judgments array<string>")


def test_scores_with_one_class(spark):
    for label in (0, 1):
        rows = judged(spark, [(1, 2, label, ["a"]), (1, 3, label, [])])
        got = scoring.judgment_scores(rows, scoring.judgment_weights(rows), rows).collect()
        assert [r.score for r in got] == [0.5, 0.5]
    none = judged(spark, [])
    assert scoring.judgment_scores(none, scoring.judgment_weights(none), none).count() == 0


def test_scores_joined_and_mapped(spark, monkeypatch):
    rows = judged(spark, [(i, i + 1, int(i % 3 == 0), [f"w{i % 5}", f"v{i % 4}"]) for i in range(1, 40)])
    mapped = {(r.id1, r.id2): r.score for r in scoring.judgment_scores(rows, scoring.judgment_weights(rows), rows).collect()}
    monkeypatch.setattr(scoring, "MAPPED", 3)
    joined = {(r.id1, r.id2): r.score for r in scoring.judgment_scores(rows, scoring.judgment_weights(rows), rows).collect()}
    assert joined == pytest.approx(mapped) and len(mapped) == 39


def test_platt_with_one_class(spark):
    rows = spark.createDataFrame([(0.1, 1), (0.9, 1)], "score double, label int")
    assert linkage.fit_platt(rows) == (0.0, 0.0)


def test_isotonic_by_range(spark, monkeypatch):
    rows = spark.createDataFrame([(k / 50, int(k % 3 > 0 or k > 30)) for k in range(50)], "score double, label int")
    blocks = linkage.fit_isotonic(rows).cache()
    new = spark.createDataFrame([(x / 37 - 0.2,) for x in range(60)], "score double")
    one = {r.score: r.calibrated for r in linkage.apply_isotonic(new, blocks).collect()}
    monkeypatch.setattr(linkage, "FEW_BLOCKS", 1)
    assert {r.score: r.calibrated for r in linkage.apply_isotonic(new, blocks).collect()} == one


def test_census_judgments(spark):
    cols = ["heimild", *judgments.NAMES, "birthyear", "sex", *judgments.PLACES]
    kinds = {"heimild": "long", "birthyear": "long"}
    schema = ", ".join(f"{c}{k} {kinds.get(c, 'string')}" for c in cols for k in (1, 2))

    def sets(**given):
        row = [given.get(f"{c}{k}") for c in cols for k in (1, 2)]
        return set(spark.createDataFrame([row], schema).select(judgments.census_judgments().alias("j")).first().j)

    assert sets() == set() == sets(surname1=" ", surname2=" ")
    for gap, name in ((0, "same_birthyear"), (2, "birthyear_very_close"), (3, "birthyear_close"), (5, "birthyear_close"), (6, "different_birthyear")):
        assert sets(birthyear1=1850, birthyear2=1850 + gap) == {name}
    for gap, name in ((0, "same_census"), (10, "adjacent_census"), (11, "distant_census")):
        assert sets(heimild1=1850 + gap, heimild2=1850) == {name}
    assert sets(first_name1="Anna ", first_name2="anna", farm1="a", farm2="b", sex1="k") == {"same_first_name", "different_farm"}


def test_dataset_judgments(spark):
    row = {"name1": "Golden Wok", "name2": "golden wok!", "addr1": "12 Main st", "addr2": "12 Maine street", "city1": "la", "city2": None, "type1": "x", "type2": "chinese", "class1": "1", "class2": "1", "phone1": "213-555 1234", "phone2": "555-1234"}
    df = spark.createDataFrame([tuple(row.values())], ", ".join(f"{c} string" for c in row))
    got = set(df.select(judgments.dataset_judgments("fodors-zagats").alias("j")).first().j)
    assert {"name_exact", "name_sim_high", "phone_last7", "addr_num_match", "class_exact", "type_sim_vlow"} <= got
    assert not any(j.startswith("city") for j in got)
    assert not any(j.startswith("phone") for j in df.select(judgments.dataset_judgments("fodors_zagats", ("phone",)).alias("j")).first().j)


def test_truth_values(spark):
    a, b = truth.truth(F.lit(1.0), F.lit(0.9)), truth.truth(F.lit(0.0), F.lit(0.9))
    r = spark.range(1).select(truth.revision(a, b).alias("r"), truth.revision(a, a).alias("s"), truth.expectation(a).alias("e"), truth.revision(truth.truth(F.lit(1.0), F.lit(1.0)), a, cap=None).alias("t")).first()
    assert (r.r.f, r.s.c, r.e) == (pytest.approx(0.5), pytest.approx(18 / 19), pytest.approx(0.95))
    assert r.t.c == pytest.approx(19 / 20)
    full = spark.range(1).select(truth.from_evidence(F.lit(1e9), F.lit(0.0)).alias("t"), truth.from_evidence(F.lit(0.0), F.lit(0.0)).alias("z")).first()
    assert full.t.c == 0.9999 and (full.z.f, full.z.c) == (0.5, 0.0)


def plain_revise(x, y):
    w = [(f * c / (1 - c), (1 - f) * c / (1 - c)) for f, c in (x, y)]
    p, n = w[0][0] + w[1][0], w[0][1] + w[1][1]
    return p / (p + n), min((p + n) / (p + n + 1), 0.9999)


def test_pattern_scores(spark):
    rows = [(i, i + 1, int(i % 3 == 0), sorted(c for c, on in zip("abcd", (i & 1, i & 2, i & 4, i & 8)) if on)) for i in range(1, 60)]
    pool = truth.pattern_pool(judged(spark, rows))
    got = {(r.id1, r.id2): r.score for r in truth.pattern_scores(judged(spark, rows), pool, 6).collect()}
    tv = {}
    for _, _, y, j in rows:
        tv[tuple(j)] = plain_revise(tv[tuple(j)], (y, 0.9)) if tuple(j) in tv else (float(y), 0.9)
    order = sorted(tv, key=lambda k: (-round(tv[k][1] * (tv[k][0] - 0.5) + 0.5, 12), ",".join(k)))
    for id1, id2, _, j in rows:
        acc = None
        for k in order[:3] + order[-3:]:
            longest = max(len(k), len(j))
            if longest:
                seen = plain_revise((len(set(j) & set(k)) / longest, tv[k][1]), tv[k])
                acc = seen if acc is None else plain_revise(acc, seen)
        assert got[id1, id2] == pytest.approx(acc[1] * (acc[0] - 0.5) + 0.5)


def test_greedy_cap(spark):
    keys = [(k % 3, k) for k in range(40)]
    got = sorted(map(tuple, blocking.capped_pairs(spark.createDataFrame(keys, "key long, id long"), 4).collect()))
    want = []
    for block in range(3):
        ids, room = [i for b, i in keys if b == block], {}
        for a, b in itertools.combinations(ids, 2):
            if room.get(a, 0) < 4 and room.get(b, 0) < 4:
                want.append((a, b))
                room[a], room[b] = room.get(a, 0) + 1, room.get(b, 0) + 1
    assert got == sorted(want)


def test_blocking_limits(spark):
    rows = spark.createDataFrame([(i, "x" if i < 5 else "y", i) for i in range(9)], "id long, name string, year int")
    with pytest.raises(ValueError, match="at most"):
        blocking.all_pairs(rows, "id", 8)
    assert blocking.all_pairs(rows, "id").count() == 36
    keys = blocking.prefix_keys(rows.withColumn("year", F.when(F.col("id") > 6, None).otherwise(F.col("year"))), "id", [F.lit(None).cast("string"), F.col("name")], F.col("year"))
    assert {r.key for r in keys.collect()} == {"x|0", "y|1", "y|-1"}
    assert blocking.pairs_in_blocks(rows.select("id", F.col("name").alias("key")), most_pairs=6).count() == 6
    left, right = rows.select("id", F.col("name").alias("key")), rows.where("id < 2").select("id", F.lit("x").alias("key"))
    assert blocking.pairs_across(left, right).count() == 10


def test_pairs_keep_missing_records(spark):
    some = spark.createDataFrame([(1, 2), (1, 99)], "id1 long, id2 long")
    records = spark.createDataFrame([(1, "a"), (2, "b")], "id long, name string")
    assert sorted((r.id2, r.name1, r.name2) for r in pairs.attach(some, records, "id", ["name"]).collect()) == [(2, "a", "b"), (99, "a", None)]


def test_evaluation_cases(spark):
    labels = spark.createDataFrame([(0, 0), (0, 0), (1, 0), (1, 1), (2, 1), (2, 1), (-1, -1)], "pred int, true int")
    assert evaluation.clustering_issues(labels).first().valid
    assert evaluation.clustering_issues(labels.where("false")).first().issues == "empty"
    assert [round(x, 6) for x in evaluation.b_cubed_with_noise(labels).first()] == [0.833333, 0.555556, 0.666667]
    assert list(evaluation.b_cubed_with_noise(labels.where("pred < 0")).first()) == [0.0, 0.0, 0.0]
    scored = spark.createDataFrame([(1, 2, 1, 1, 0.9), (2, 1, 0, 0, 0.1)], "id1 long, id2 long, label int, prediction int, score double")
    s = evaluation.sanity_checks(scored).first()
    assert not s.pair_symmetry_consistent and not s.all_passed and s.scores_in_valid_range
    assert not evaluation.sanity_checks(scored.where("false")).first().labels_not_empty
    assert evaluation.roc_auc_ordinal(scored.where("label = 1")).first().auc is None
    cases = [(None, "unknown"), (0.95, "excellent"), (0.9, "good"), (0.81, "ok"), (0.1, "poor")]
    got = spark.createDataFrame([(x,) for x, _ in cases], "x double").select(evaluation.grade(F.col("x")).alias("g")).collect()
    assert [r.g for r in got] == [g for _, g in cases]


def test_conclusions(spark):
    cols = "edges_total long, semi_novel_edges long, novel_edges long, prec_labeled double, prec_low double, prec_high double"
    rows = spark.createDataFrame([(500, 3, 4, 0.96, 0.93, 0.98), (20, 0, 0, 0.5, 0.2, 0.8), (0, 1, 0, None, None, None)], cols)
    assert [tuple(r) for r in evaluation.conclusions(rows).collect()] == [("excellent", "tight", "reasonable", "strong"), ("poor", "wide", "low", "none"), ("unknown", "unknown", "none", "precision unknown")]


def test_stable_ids(spark):
    comps = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 4), (7, 7)], "id long, component_id long")
    got = {r.smallest: (r.cluster_id, r.size) for r in evaluation.stable_cluster_ids(comps).collect()}
    assert got == {1: (0, 3), 4: (1, 3), 7: (2, 1)}


def test_text_classifiers(spark):
    rows = [(i, i + 1, f"red bolt {i % 7}", f"red bolt {i % 7}" if i % 2 else f"green nut {i % 5}", i % 2) for i in range(80)]
    df = spark.createDataFrame(rows, "id1 long, id2 long, left_text string, right_text string, label int")
    for kind, params in (("logistic", {}), ("forest", {"numTrees": 5}), ("boosted", {"maxIter": 3}), ("perceptron", {"maxIter": 20})):
        scored = models.TextClassifier(kind, **params).fit(df).score(df)
        assert scored.columns == [*df.columns, "score"]
        assert scored.where("(score >= 0.5) = (label = 1)").count() >= 70
    with pytest.raises(RuntimeError):
        models.TextClassifier().score(df)


def test_other_scorers(spark):
    df = spark.createDataFrame([(1, 2, "ab", "abc"), (2, 3, None, "x")], "id1 long, id2 long, left_text string, right_text string")

    def make():
        return lambda a, b: abs(__import__("numpy").array([len(x) for x in a]) - __import__("numpy").array([len(x) for x in b])).astype(float)

    assert sorted(r.score for r in models.BatchScorer(make).fit(df).score(df).collect()) == [1.0, 1.0]
    with pytest.raises(models.Unavailable):
        models.ExternalScorer("neural").score(df)
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 1.0]), (3, [0.0, 0.0])], "vec_id long, embedding array<float>")
    got = {r.id2: r.score for r in models.embedding_scores(df.select("id1", "id2"), v).collect()}
    assert got[2] == pytest.approx(math.sqrt(0.5)) and got[3] is None


def test_three_way_and_training_pairs(spark):
    gt = spark.createDataFrame([(i, f"{'ab'[i % 2]}x", float(i % 9), i % 10) for i in range(60)], "id long, text string, number double, cluster long")
    got = pairs.training_pairs(gt, 20).collect()
    assert sum(r.label for r in got) == 20 and len(got) == 40
    assert all((r.id1 % 10 == r.id2 % 10) == bool(r.label) for r in got)
    split = pairs.three_way(pairs.truth_pairs(gt)).groupBy("split").count().collect()
    assert {r.split: r["count"] for r in split} == {"train": 105, "val": 22, "test": 23}
