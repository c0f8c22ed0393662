import json

import pytest
from pyspark.sql import functions as F

from kindred import runner
from kindred.plans import stage
from kindred.sources import sinks, tables
from kindred.streaming import incremental


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")


PEOPLE = """id,heimild,nafn_norm,first_name,patronym,surname,birthyear,sex,person,partner,father,mother,parish
1,1850,Jon Jonsson,Jon,Jonsson,,1820,Karl,10,,,,7.0
2,1860,jon jonsson,jon,jonsson,,1821,karl,10,3,,,7
3,x,"Anna, dottir",Anna,,Briem,,kona,11,2,,,
,1870,ghost,,,,,,,,,,
4,1905,Olaf,Olaf,,Briem,1890.0,karl,,,1,3,8
"""


def test_people(spark, tmp_path):
    write(tmp_path / "people.csv", PEOPLE)
    p = tables.read_people(spark, str(tmp_path / "people.csv"))
    rows = {r.id: r for r in p.collect()}
    assert set(rows) == {1, 2, 3, 4}
    assert (rows[1].nafn_norm, rows[1].surname, rows[1].parish, rows[3].heimild, rows[4].birthyear, rows[3].nafn_norm) == ("jon jonsson", None, 7, None, 1890, "anna, dottir")
    text = {r.id: r.text for r in tables.people_text(p).collect()}
    assert text[1] == "jon jonsson jon jonsson karl by:1820 parish:7"
    assert {(r.id, r.cluster) for r in tables.truth_of(p).collect()} == {(1, 10), (2, 10), (3, 11)}
    labels = spark.createDataFrame([("1", "5"), ("9", "6")], "id string, bi_einstaklingur string")
    unknown = p.withColumn("person", F.lit(None).cast("long"))
    assert {(r.id, r.cluster) for r in tables.truth_of(unknown, labels).collect()} == {(1, 5), (2, None), (3, None), (4, None)}


def two_tables(folder):
    write(folder / "tableA.csv", "key,name,price\n1,red bolt,10\n2,blue nut,20\n3,old cap,5\n4,new pin,7\n")
    write(folder / "tableB.csv", "id,name,price\n1,red  bolt,10\n2,green nut,21\n3,old cap,5\n4,pin,9\n")
    rows = [(a, b, int(a == b)) for a in range(1, 5) for b in range(1, 5)]
    head = "ltable_id,rtable_id,label\n"
    write(folder / "train.csv", head + "".join(f"{a},{b},{y}\n" for a, b, y in rows))
    write(folder / "valid.csv", "Left_ID,id_b,is_match\n" + "".join(f"{a},{b},{y}\n" for a, b, y in rows[:6]))
    write(folder / "test.csv", head + "".join(f"{a},{b},{y}\n" for a, b, y in rows) + "1,1,maybe\n")


def test_two_tables(spark, tmp_path):
    two_tables(tmp_path)
    got = tables.read_two_tables(spark, str(tmp_path))
    assert {r.id: r.text for r in got["left"].collect()}["1"] == "red bolt 10"
    assert got["val"].columns == ["ltable_id", "rtable_id", "label"] and got["val"].agg(F.sum("label")).first()[0] == 2
    assert got["test"].where("label = 0").count() == 13


def test_clusters_text(spark):
    rows = [("1;2;3", [1, 2, 3]), ("[1, 2, 3]", [1, 2, 3]), ("7", [7]), ("", []), ("a;2", [2])]
    got = spark.createDataFrame([(t,) for t, _ in rows], "m string").select(tables.members_of(F.col("m")).alias("x")).collect()
    assert [r.x for r in got] == [x for _, x in rows]


def test_versions(spark, tmp_path):
    edges = spark.createDataFrame([(2, 1), (1, 2), (3, 3)], "id1 long, id2 long")
    clusters = spark.createDataFrame([(1, 2, [1, 2])], "cluster_id long, size long, members array<long>")
    folder = sinks.save_version(spark, "here", edges, clusters, str(tmp_path), "first", "v1")
    e, c, meta = sinks.load_version(spark, folder)
    assert [tuple(r) for r in e.collect()] == [(1, 2)] and c.first().members == [1, 2] and meta["comment"] == "first"
    with pytest.raises(FileExistsError):
        sinks.save_version(spark, "here", edges, clusters, str(tmp_path), name="v1")
    with pytest.raises(FileNotFoundError):
        sinks.load_version(spark, str(tmp_path / "none"))
    assert [p.rsplit("/", 1)[1] for p in tables.backends(spark, str(tmp_path))] == ["v1"]


def test_exports(spark, tmp_path):
    records = spark.createDataFrame([(1, "red", None), (2, "blue", 3)], "id long, name string, n long")
    some = spark.createDataFrame([(1, 2, 0)], "id1 long, id2 long, label int")
    assert sinks.ditto_lines(some, records, "id", ["name", "n"]).first().line == "0\tCOL name VAL red COL n VAL  [SEP] COL name VAL blue COL n VAL 3"
    nodes, edges = sinks.graph_json(some, records, "id", ["name", "n"])
    assert json.loads(edges.first().json) == {"source": 1, "target": 2, "label": 0}
    assert {r.id: json.loads(r.json) for r in nodes.collect()}[1] == {"name": "red", "n": None}
    dot = sinks.dot_text(some.select("id1", "id2", F.lit("kin").alias("rel")), spark.createDataFrame([(1, 'a "b"')], "id long, label string"), directed=True).first().dot
    assert dot == 'digraph G { rankdir="LR"; node [shape=box];\n  "1" [label="a \\"b\\""];\n  "1" -> "2" [label="kin"];\n}'
    sinks.write_zeroer(records, None, str(tmp_path / "z"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "z/metadata.txt")).collect()] == ["name", "n"]
    says = sinks.narsese_pairs(spark.createDataFrame([(1, 2, ["same_sex"])], "id1 long, id2 long, judgments array<string>"))
    assert says.first().statement == "<({1} * {2}) --> [same_sex]>. :|:"


def config(path, **sections):
    return {"dataset": {"name": "two_tables", "params": {"path": str(path)}}, "model": {"name": "judgments", "params": {"compare": "fields", "fields": ["name", "price"]}}, "calibration": {"name": "grid"}, **sections}


def test_run(spark, tmp_path):
    two_tables(tmp_path / "data")
    out = runner.run(spark, config(tmp_path / "data", name="one", output=str(tmp_path / "out")))
    assert 0 < out["threshold"] < 1 and out["pairwise_recall"] > 0.5 and "ranking_ap" in out
    assert tables.exists(spark, str(tmp_path / "out/one/edges.csv"))


def test_run_on_people(spark, tmp_path):
    rows = [(i, 1850 + 10 * (i % 3), f"name{i // 3}", f"first{i // 3}", 1800 + i // 3, i // 3) for i in range(60)]
    spark.createDataFrame(rows, "key long, heimild long, nafn_norm string, first_name string, birthyear long, who long").write.parquet(str(tmp_path / "p"))
    base = {"dataset": {"name": "parquet", "params": {"path": str(tmp_path / "p"), "id": "key", "cluster": "who", "columns": {c: c for c in ("heimild", "nafn_norm", "first_name", "birthyear")}}}, "blocking": {"name": "prefix", "params": {"fields": ["nafn_norm"], "year": "birthyear", "letters": 5}}}
    grid = {"base": {**base, "model": {"name": "fellegi_sunter", "params": {"fields": ["nafn_norm", "first_name"]}}}, "grid": {"calibration.name": ["median", "platt"], "clustering.name": ["components", "none"]}}
    got = runner.run_grid(spark, grid)
    assert [r["param_clustering.name"] for r in got] == ["components", "none"] * 2
    assert got[0]["pairwise_f1"] == 1.0 and got[0]["sanity_has_positive_labels"] and "no clusterer none" in got[1]["error"]


def test_config(tmp_path, capsys):
    assert runner.validate({}) == ["section dataset is missing", "section model is missing"]
    assert runner.validate({**config("x"), "blocking": {"name": "odd"}, "more": 1}) == ["blocking.name: no blocker odd", "section more is unknown"]
    assert runner.main(["list", "calibrators"]) == 0 and "platt" in capsys.readouterr().out
    store = runner.ProfileStore(str(tmp_path / "profiles"))
    store.save("mine", {"a": 1})
    assert store.load("mine") == {"a": 1} and "mine" in store.names() and store.load("overlap")["model"]["name"] == "judgments"
    store.delete("mine")
    assert "mine" not in store.names()
    assert runner.backend_flags({"gb": {"depth": 3}}, {"gb": {"rate": 0.1}, "x": None}) == ["--gb_depth", "3", "--gb_rate", "0.1"]


def test_reusable(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.range(3)

    for _ in range(2):
        assert runner.reusable(spark, str(tmp_path), {"blocker": "token"}, make).count() == 3
    assert len(made) == 1


def test_streams(spark, tmp_path):
    spark.createDataFrame([(10, "red bolt"), (11, "green cap")], "id long, name string").write.parquet(str(tmp_path / "in"))
    index = spark.createDataFrame([(1, "bolt"), (2, "bolt"), (3, "cap"), (4, "red")], "id long, key string")
    new = spark.readStream.schema("id long, name string").parquet(str(tmp_path / "in"))
    incremental.link_stream(new, index, F.col("name"), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert sorted((r.id1, r.id2, r.shared) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(10, 1, 1), (10, 2, 1), (10, 4, 1), (11, 3, 1)]


def test_stage_root(spark, monkeypatch):
    class Far:
        class sparkContext:  # noqa: N801
            master = "yarn"

        class conf:  # noqa: N801
            get = staticmethod(lambda key, default=None: default)

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        stage.stage_root(Far)
