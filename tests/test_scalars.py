import math
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred.functions import similarity
from kindred.functions import text as tx
from kindred.operators import ranks


def values(spark, rows, *cols):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, x string")
    return [r[0] for r in df.select("i", cols[0](F.col("x")).alias("y")).orderBy("i").select("y").collect()]


def test_parsers(spark):
    numbers = {"3.14159265": 3.14159265, "1234567890123456": 1234567890123456.0, "$1,299.50": 1299.5, "-5": -5.0, ".5x": 0.5, "none": None, "": None, None: None, "7.": 7.0}
    assert values(spark, numbers, tx.parse_number) == list(numbers.values())
    years = {"born 1850?": 1850, "1699": None, "2001-1999": 2001, "x": None}
    assert values(spark, years, tx.parse_year) == list(years.values())
    seconds = {"3:05": 185, "1:00:01": 3601, "42": 42, "a:b": None, "1:2:3:4": None, " 2 : 3 ": 123}
    assert values(spark, seconds, tx.parse_seconds) == list(seconds.values())
    phones = {"+354 (555) 1234": "5551234", "12-34": None}
    assert values(spark, phones, tx.phone_last7) == list(phones.values())


def test_soundex_of_long_words(spark):
    assert values(spark, ["b" + "a" * 3000 + "rt"], tx.block_soundex) == ["B630"]


def test_log_values(spark):
    got = values(spark, ["epoch 2/9 loss=0.5 Accuracy = 88.2% acc=0.1 lr=1e-3", "nothing here", None], tx.log_values)
    assert got == [{"loss": 0.5, "accuracy": pytest.approx(0.882), "lr": 0.001, "acc": pytest.approx(0.882)}, {}, None]


def test_words_for_people(spark):
    assert values(spark, [" Ábc--Def!_x ", "", "###"], tx.term) == ["bc_def_x", "unknown", "unknown"]
    sizes = spark.createDataFrame([(0,), (1023,), (2048,), (5 * 1024**4,), (3 * 1024**5,)], "n long").select(tx.human_bytes(F.col("n")).alias("s")).collect()
    assert [r.s for r in sizes] == ["0.0 B", "1023.0 B", "2.0 KB", "5.0 TB", "3.0 PB"]


def test_similarities(spark):
    rows = [("jon", "john"), ("martha", "marhta"), ("dixon", "dicksonx"), ("", "a"), ("same", "same"), (None, "x"), ("abcd", "wxyz")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a string, b string")
    got = df.select("i", similarity.jaro_winkler(F.col("a"), F.col("b")).alias("jw"), similarity.sequence_ratio(F.col("a"), F.col("b")).alias("r")).orderBy("i").collect()
    assert got[1].jw == pytest.approx(0.961111, abs=1e-6) and got[2].jw == pytest.approx(0.813333, abs=1e-6)
    assert got[4].jw == 1.0 and got[5].jw is None and got[6].jw == 0.0
    assert [r.r for r in got if r.r is not None] == [SequenceMatcher(None, a, b).ratio() if a and b else 0.0 for a, b in rows if a is not None]


def test_quantiles(spark):
    rng = np.random.default_rng(1)
    rows = [("a", float(x)) for x in rng.normal(size=3001)] + [("b", float(k // 7)) for k in range(500)] + [("c", 2.5), ("c", None)]
    df = spark.createDataFrame(rows, "g string, x double")
    qs = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {(r.g, r.q): r.x for r in ranks.quantiles(df, "x", qs, ["g"]).collect()}
    for g in "abc":
        have = [x for k, x in rows if k == g and x is not None]
        for q in qs:
            assert got[g, q] == pytest.approx(np.quantile(have, q))
    assert ranks.quantiles(df.where("g = 'c'"), "x", [0.5]).first().x == 2.5
    assert ranks.quantiles(df.where("false"), "x", [0.5]).count() == 0


def test_ranks(spark, monkeypatch):
    monkeypatch.setattr(ranks, "BUCKET", 50)
    df = spark.range(1000).select("id", ((F.col("id") * 7919) % 613).alias("k"))
    by_hash = [r.rank for r in ranks.hash_rank(df, F.col("k") * 3_000_000, "id").orderBy("k", "id").collect()]
    assert by_hash == list(range(1000))
    assert [r.rank for r in ranks.ordered_rank(df, "k", "id").orderBy("k", "id").collect()] == list(range(1000))
    assert ranks.ordered_rank(df.where("false"), "k", "id").count() == 0


def test_bands(spark):
    row = spark.range(1).select(tx.similarity_band(F.lit(0.9)).alias("a"), tx.similarity_band(F.lit(0.6)).alias("b"), tx.logit(F.lit(0.5)).alias("c"), tx.edge_key(F.lit(9), F.lit(10)).alias("d"), tx.percent(F.lit(None).cast("double")).alias("e")).first()
    assert (row.a, row.b, row.c, row.d, row.e) == ("high", "low", 0.0, "9_10", "—")
    assert math.isclose(spark.range(1).select(tx.sigmoid(F.lit(0.0))).first()[0], 0.5)
