import numpy as np
from pyspark.sql import functions as F

from kindred.functions import text as tx
from kindred.operators import blocking, evaluation, scoring
from kindred.operators.components import connected_components


def test_block_soundex(spark):
    known = {"robert": "R163", "rupert": "R163", "ashcraft": "A261", "tymczak": "T520", "pfister": "P236", "jackson": "J500", "honeyman": "H500", "dodd": "D000", "lloyd": "L300", "jónsson": "J525", "þór": "Þ600", "áslaug": "Á242", "123": ""}
    got = spark.createDataFrame([(w,) for w in known], "w string").select("w", tx.block_soundex(F.col("w")).alias("c")).collect()
    assert {r.w: r.c for r in got} == known


def test_wilson(spark):
    low, high = tx.wilson(F.lit(90.0), F.lit(100.0))
    r = spark.range(1).select(low.alias("a"), high.alias("b")).first()
    assert (round(r.a, 6), round(r.b, 6)) == (0.825633, 0.944771)


def test_token_blocking(spark):
    people = spark.createDataFrame([(1, "John Smith"), (2, "Jon Smith"), (3, "Jane Doe"), (4, "John Doe"), (5, "Bob Jones")], "id long, name string")
    pairs = blocking.pairs_in_blocks(blocking.token_keys(people, "id", F.col("name")), 1000)
    assert sorted(map(tuple, pairs.collect())) == [(1, 2), (1, 4), (3, 4)]
    truth = spark.createDataFrame([(1, 2), (1, 3)], "id1 long, id2 long")
    q = blocking.blocking_quality(pairs, truth, F.lit(5)).first()
    assert (q.n_captured, q.recall, round(q.reduction_ratio, 6)) == (1, 0.5, 0.7)


def test_confusion_and_auc(spark):
    rows = spark.createDataFrame([(1, 0.9), (1, 0.4), (0, 0.1), (0, 0.6), (1, 0.8), (0, 0.2)], "label int, score double")
    m = scoring.confusion(rows).first()
    assert (m.tp, m.fp, m.fn, m.tn) == (2, 1, 1, 2) and round(m.f1, 6) == round(2 / 3, 6)
    assert round(evaluation.roc_auc(rows).first().auc, 6) == round(8 / 9, 6)
    ties = spark.createDataFrame([(1, 0.5), (0, 0.5)], "label int, score double")
    assert evaluation.roc_auc(ties).first().auc == 0.5


def test_clustering_metrics(spark):
    pred, true = [0, 0, 1, 1, 2, 2], [0, 0, 0, 1, 1, 1]
    m = evaluation.clustering_metrics(spark.createDataFrame([(i, p, t) for i, (p, t) in enumerate(zip(pred, true))], "id int, pred int, true int")).first()
    assert [round(x, 6) for x in m] == [0.242424, 0.529541, 0.833333, 0.555556, 0.666667]


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (1, 3), (2, 3), (4, 5), (6, 4), (8, 8), (None, 9)], "id1 long, id2 long")
    got = connected_components(edges, nodes=spark.range(1, 9))
    assert dict(map(tuple, got.collect())) == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 4, 7: 7, 8: 8}
    chain = spark.range(300).select(F.col("id").alias("id1"), (F.col("id") + 1).alias("id2"))
    assert [tuple(r) for r in connected_components(chain).groupBy("component_id").count().collect()] == [(0, 301)]
    assert connected_components(edges.where("false")).count() == 0


def test_components_write_few_files(spark, monkeypatch):
    """The edges of a small graph don't take a file for each shuffle partition, round by round."""
    from pathlib import Path

    from kindred.operators import components

    files, write = [], components.staged

    def counted(*args):
        out = write(*args)
        files.append(len(list(Path(out.staged_path.removeprefix("file://")).glob("part-*"))))
        return out

    monkeypatch.setattr(components, "staged", counted)
    given = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in given}
    for k, v in given.items():
        spark.conf.set(k, v)
    try:
        chain = spark.range(600).selectExpr("id as id1", "id + 1 as id2").where("id1 % 301 != 300")
        assert sorted(r["count"] for r in connected_components(chain).groupBy("component_id").count().collect()) == [300, 301]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(files) > 3 and max(files[1:]) <= 2 * spark.sparkContext.defaultParallelism


def test_power_tables_fit_their_texts():
    """A short batch makes short tables, a long one those that it needs; both give one hash."""
    from kindred.llm import text

    values = np.arange(1, 3000)
    text._tables.clear()
    short = text.spans(values[:500], np.array([3]), np.array([400]), 12345)
    assert len(text._tables[12345][0]) <= 1024
    assert text.spans(values, np.array([3]), np.array([400]), 12345) == short
    assert len(text._tables[12345][0]) <= 4096


def test_entry_imports():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
