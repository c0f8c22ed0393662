"""Findings of round 3, each with a case that failed before."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from kindred.functions import text as tx
from kindred.operators import blocking


def test_blocking_quality_of_many_records(spark):
    """the number of all pairs of 50,000 records is no int."""
    one = spark.createDataFrame([(1, 2)], "id1 long, id2 long")
    q = blocking.blocking_quality(one, one, F.lit(50_000)).first()
    assert q.reduction_ratio == pytest.approx(1 - 1 / (50_000 * 49_999 / 2), abs=1e-15)


def _part(tmp_path, spark, rows):
    """A folder with a part table of (key, name, brand, type, size, price)."""
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    return str(tmp_path)


def _sql(name, d, *tables):
    """The rows of a query's SQL on the tables of a folder."""
    import __spark_entry__
    import duckdb

    con = duckdb.connect()
    for t in tables:
        con.sql(f"create view {t} as select * from read_parquet('{d}/{t}.parquet/*.parquet')")
    return con.sql(__spark_entry__.oracle_sql()[name]).fetchall()


def test_text_labels_of_large_ids(spark, tmp_path):
    """the query's SQL writes sizes over a megabyte in KB."""
    import __spark_entry__

    d = _part(tmp_path, spark, [(i, "hot bolt", "Brand#1", "SMALL", 5, 900.0) for i in (7, 511, 512, 524_287, 524_289, 1_199_999)])
    got = __spark_entry__.queries()["text_labels"](spark, d).collect()
    assert sorted(map(tuple, got)) == sorted(_sql("text_labels", d, "part"))
    assert [r.b for r in spark.range(1).select(tx.human_bytes(F.lit(3 * 1024**2)).alias("b")).collect()] == ["3.0 MB"]


def test_pairs_within_blocks_of_many_runs(spark):
    """Blocks of less than a run, of a run and of several, and null keys, against plain pairs."""
    from kindred.operators import tiles

    rows = [(i * 7 % 61, "abc"[i % 3] if i % 10 else None, i % 2, f"v{i}") for i in range(61)]
    df = spark.createDataFrame(rows, "id long, k string, s int, v string")
    got = tiles.pairs_within(df, ["k", "s"], "id", ["v"], size=3).collect()
    want = [(a[0], b[0], a[3], b[3]) for a in rows for b in rows if a[1] is not None and a[1:3] == b[1:3] and a[0] < b[0]]
    assert sorted(map(tuple, got)) == sorted(want)


def test_geo_pairs_of_a_large_block(spark, tmp_path):
    """a block of over 5000 customers keeps its pairs."""
    from kindred.plans.catalogue import geo_block_pairs

    n = 5001
    spark.range(n).selectExpr("id as c_custkey", "1 as c_nationkey", "'AUTO' as c_mktsegment").write.parquet(f"{tmp_path}/customer.parquet")
    got = geo_block_pairs(spark, str(tmp_path)).agg(F.count("*").alias("n"), F.count_if(F.col("id1") >= F.col("id2")).alias("bad"), F.sum("id1").alias("s")).first()
    assert (got.n, got.bad, got.s) == (n * (n - 1) // 2, 0, sum(i * (n - 1 - i) for i in range(n)))


def test_pairs_of_a_small_file_are_dealt(spark, tmp_path):
    """4.5 million pairs of 3,000 parts in one file are no one task's."""
    from kindred.plans import linkage_catalogue as lc

    d = _part(tmp_path, spark, [(i, "hot bolt", "Brand#1", "SMALL", 5, 900.0) for i in range(3000)])
    for pairs in (lc._ruled(spark, d), lc._pairs(spark, d)):
        assert pairs.rdd.getNumPartitions() >= 4


def test_few_values_are_compared_once(spark, monkeypatch):
    from kindred.operators import linkage, tiles

    rows = [(i, 1, w) for i, w in enumerate(["a b", "b c", None, "a b", " ", "c", "b  c"])]
    df = spark.createDataFrame(rows, "id long, k int, w string")

    def run():
        some, carried, got = tiles.by_values(df, "w", {"s": lambda x, y: linkage.rule("jaccard", x, y), "t": lambda x, y: F.concat_ws("/", x, y)})
        return carried, sorted(map(tuple, tiles.pairs_within(some, ["k"], "id", [carried]).select("id1", "id2", got["s"], got["t"]).collect()))

    (few, one), _ = run(), monkeypatch.setattr(tiles, "FEW_VALUES", 3)
    many, other = run()
    assert (few, many) == ("__w", "w") and one == other and len(one) == 21 and one[0] == (0, 1, 1 / 3, "a b/b c")


@pytest.mark.parametrize("tied", [2, 1 << 17])
def test_ranks_of_tied_scores(spark, monkeypatch, tied):
    """Pure and mixed scores, with ties in one slot or in many, against a plain order."""
    import random

    from kindred.operators import clusters, evaluation

    monkeypatch.setattr(evaluation, "TIED", tied)
    r = random.Random(5)
    rows = [(i, 1000 - i, 10 * i, s, int(s in (0.3, 0.9) or (s < 0.7 and r.random() < 0.4))) for i, s in ((i, r.choice([0.1, 0.3, 0.5, 0.6, 0.8, 0.9])) for i in range(600))]
    df = spark.createDataFrame(rows, "id1 long, id2 long, id long, score double, label int")
    tp, at = 0, []
    for k, x in enumerate(sorted(rows, key=lambda x: (-x[3], x[2])), 1):
        tp += x[4]
        at += [tp / k] if x[4] else []
    assert clusters.average_precision(df).first().ap == pytest.approx(sum(at) / len(at), abs=1e-12)
    ranks = [k for k, x in enumerate(sorted(rows, key=lambda x: (x[3], x[0], x[1])), 1) if x[4]]
    p, n = len(ranks), len(rows) - len(ranks)
    assert evaluation.roc_auc_ordinal(df).first().auc == pytest.approx((sum(ranks) - p * (p + 1) / 2) / (p * n), abs=1e-12)


def test_three_way_by_exact_ranks(spark):
    """the split by two cuts is that of the whole order."""
    from kindred.operators import pairs

    rows = [(i, j) for i in range(40) for j in range(i + 1, 40)]
    key = lambda x: ((x[0] * 40503 + x[1] * 2654435761 + 42) % 2147483648, *x)
    n = len(rows)
    want = {x: "train" if k < int(0.7 * n) else "val" if k < int(0.85 * n) else "test" for k, x in enumerate(sorted(rows, key=key))}
    got = pairs.three_way(spark.createDataFrame(rows, "id1 long, id2 long")).collect()
    assert {(r.id1, r.id2): r.split for r in got} == want
    assert pairs.three_way(spark.createDataFrame([], "id1 long, id2 long")).count() == 0


def test_sanity_sees_mirrored_pairs(spark):
    """mirrored pairs are sought only where some pair stands backwards."""
    from kindred.operators import evaluation

    of = lambda rows: evaluation.sanity_checks(spark.createDataFrame(rows, "id1 long, id2 long, label int, prediction int, score double")).first().pair_symmetry_consistent
    a, b = (1, 2, 1, 1, 0.9), (3, 4, 0, 0, 0.1)
    assert of([a, b]) and of([a, (4, 3, 0, 0, 0.1)]) and not of([a, b, (2, 1, 1, 1, 0.9)])


@pytest.mark.parametrize("name", ["census_judgments", "fs_jw_threshold"])
def test_people_pairs_equal_their_sql(spark, tmp_path, name):
    """Pairs carry their fields, and results of few values are looked up."""
    import __spark_entry__

    rows = [(i, f"{'hot cold old'.split()[i % 3]} {'bolt ring'.split()[i % 2]}", f"Brand#{i % 4}", "SMALL", i % 2 + 5, 900.0 + i) for i in range(60)]
    d = _part(tmp_path, spark, rows)
    got = __spark_entry__.queries()[name](spark, d)
    assert sorted(map(tuple, got.collect())) == sorted(_sql(name, d, "part"))


def test_people_pairs_are_dealt(spark, tmp_path):
    """4.5 million pairs of one file are no one task's."""
    from kindred.plans import model_catalogue as mc, shared

    d = _part(tmp_path, spark, [(i, "hot bolt", "Brand#1", "SMALL", 5, 900.0) for i in range(3000)])
    for pairs in (shared.people_pairs(spark, d, ["surname"]), mc._close(spark, d)):
        assert pairs.rdd.getNumPartitions() >= 4


def test_long_columns_are_dealt(spark, tmp_path):
    """events of one file are no one task's; the last value of a name counts."""
    from kindred.plans.blocking_catalogue import log_values

    n = 140_000
    spark.range(n).coalesce(1).selectExpr("id as event_id", "1.5D as value", "id % 7 as user_id").write.parquet(f"{tmp_path}/events.parquet")
    got = log_values(spark, str(tmp_path))
    assert got.rdd.getNumPartitions() == 3
    assert got.where("loss = 1.5 and acc = 0.015 and user_id = event_id % 7").count() == n
    line = F.lit("accuracy=2 ACC = 3 x=1 x=4%")
    assert spark.range(1).select(tx.log_values(line).alias("m")).first().m == {"acc": 2.0, "accuracy": 2.0, "x": 0.04}


def test_true_pairs_of_a_large_cluster(spark):
    """4.5 million pairs of one cluster are no one task's; they are counted without being made."""
    from kindred.operators import pairs

    one = spark.range(3000).selectExpr("id", "id div 10000 as cluster").coalesce(1)
    assert pairs.truth_pairs(one).rdd.getNumPartitions() >= 4
    assert pairs.n_truth_pairs(one) == 3000 * 2999 // 2
    some = spark.createDataFrame([(1, 1), (1, 1), (2, 1), (3, None), (4, 2)], "id long, cluster long")
    assert pairs.n_truth_pairs(some) == pairs.truth_pairs(some).count() == 2
    keys = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a"), (4, "b"), (5, "b")], "id long, key string")
    clusters = spark.createDataFrame([(1, "x"), (2, "x"), (3, None), (4, "y"), (5, "y")], "id long, cluster string")
    by = lambda *a: sorted(map(tuple, blocking.blocking_curve(keys, *a).collect()))
    assert by(None, 5, (2, 3), clusters) == by(pairs.truth_pairs(clusters), 5, (2, 3)) == [(2, 1, 0.2, 0.5), (3, 4, 0.8, 1.0)]
