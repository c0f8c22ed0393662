"""Canonical tables from files and frames: people, labels, edges, clusters, pairs.

Text files are read as strings and coerced column by column: what doesn't parse is null, blank is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.functions.text import clean
from kindred.operators.clusters import canonical

# Columns of the canonical tables.
PEOPLE_NUMBERS = ("id", "heimild", "birthyear", "person", "partner", "father", "mother", "farm", "county", "parish", "district")
PEOPLE_TEXTS = ("nafn_norm", "first_name", "middle_name", "patronym", "surname", "sex", "status", "marriagestatus")
PEOPLE_ORDER = ("id", "heimild", "nafn_norm", "first_name", "middle_name", "patronym", "surname", "birthyear", "sex", "status", "marriagestatus", "person", "partner", "father", "mother", "farm", "county", "parish", "district")
TEXT_FIELDS = ("nafn_norm", "first_name", "middle_name", "patronym", "surname", "sex", "status", "marriagestatus")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file or folder with a header, every column a string; Spark splits it by itself."""
    return spark.read.csv(path, header=True, inferSchema=False, multiLine=False, escape='"')


def canonicalize(df: DataFrame, rename: dict[str, str] | None = None, required: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with columns renamed and the required ones that it lacks added as null strings."""
    out = df.withColumnsRenamed(rename or {})
    return out.withColumns({c: F.lit(None).cast("string") for c in required if c not in out.columns})


def whole(c: Column) -> Column:
    """A whole number of a text such as 12 or 12.0; null if it is none."""
    return clean(c.cast("string")).try_cast("double").try_cast("long")


def people(raw: DataFrame, rename: dict[str, str] | None = None) -> DataFrame:
    """The canonical people table: numbers coerced, texts trimmed and lower-cased, rows without an id left out."""
    df = canonicalize(raw, rename, PEOPLE_ORDER)
    cols = [(whole(F.col(c)) if c in PEOPLE_NUMBERS else clean(F.lower(F.col(c).cast("string")))).alias(c) for c in PEOPLE_ORDER]
    return df.select(*cols).where("id is not null")


def read_people(spark: SparkSession, path: str, rename: dict[str, str] | None = None) -> DataFrame:
    return people(read_csv(spark, path), rename)


def split_counts(records: DataFrame) -> DataFrame:
    """(split, n_records, n_labelled, n_clusters) of records with split and person."""
    return records.groupBy("split").agg(F.count("*").alias("n_records"), F.count("person").alias("n_labelled"), F.count_distinct("person").alias("n_clusters"))


def truth_of(records: DataFrame, labels: DataFrame | None = None, cluster: str = "bi_einstaklingur") -> DataFrame:
    """(id, cluster): from person if any record has one of 0 or more, else from the label table."""
    own = records.where("person >= 0").select("id", F.col("person").alias("cluster"))
    if labels is None or records.where("person >= 0").limit(1).count():
        return own
    return records.select("id").join(labels.select(F.col("id").cast("long").alias("id"), whole(F.col(cluster)).alias("cluster")), "id", "left")


def people_text(records: DataFrame) -> DataFrame:
    """(id, text): names and statuses, by:<birth year> and parish:<id>, those that are there."""
    parts = [clean(F.col(c)) for c in TEXT_FIELDS]
    tagged = [F.concat(F.lit(f"{t}:"), F.col(c).cast("string")) for t, c in (("by", "birthyear"), ("parish", "parish"))]
    return records.select("id", F.concat_ws(" ", *parts, *tagged).alias("text"))


def record_text(records: DataFrame, id_col: str = "id") -> DataFrame:
    """(id, text): all other columns that are not blank, in order."""
    cols = [c for c in records.columns if c.lower() not in (id_col.lower(), "id", "text")]
    return records.select(F.col(id_col).alias("id"), F.concat_ws(" ", *(clean(F.col(f"`{c}`").cast("string")) for c in cols)).alias("text"))


def two_tables(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables with id (the first column where none has that name) and text."""
    out = []
    for t in (left, right):
        t = t if "id" in t.columns else t.withColumnRenamed(t.columns[0], "id")
        out.append(t if "text" in t.columns else t.join(record_text(t), "id"))
    return out[0], out[1]


def read_two_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """left, right, train, val and test of a folder with tableA, tableB, train, valid and test CSV files."""
    left, right = two_tables(read_csv(spark, f"{folder}/tableA.csv"), read_csv(spark, f"{folder}/tableB.csv"))
    out = {"left": left, "right": right}
    for name, file in (("train", "train"), ("val", "valid"), ("test", "test")):
        out[name] = pair_table(read_csv(spark, f"{folder}/{file}.csv")) if exists(spark, f"{folder}/{file}.csv") else spark.createDataFrame([], "ltable_id string, rtable_id string, label int")
    return out


def pair_table(raw: DataFrame) -> DataFrame:
    """(ltable_id, rtable_id, label): columns found by their names, labels that don't parse are 0."""
    names = {}
    for c in raw.columns:
        low = c.lower()
        for target, parts, exact in (("ltable_id", ("ltable", "left"), "id_a"), ("rtable_id", ("rtable", "right"), "id_b"), ("label", ("label", "match"), None)):
            if target not in names and (low == exact or any(p in low for p in parts)):
                names[target] = c
                break
    pick = lambda t: F.col(f"`{names[t]}`") if t in names else F.lit("")
    label = F.coalesce(pick("label").cast("string").try_cast("double").try_cast("int"), F.lit(0))
    return raw.select(pick("ltable_id").cast("string").alias("ltable_id"), pick("rtable_id").cast("string").alias("rtable_id"), label.alias("label"))


def edge_table(raw: DataFrame, id1: str = "id1", id2: str = "id2", score: str | None = None) -> DataFrame:
    """(id1, id2[, score]): ends as whole numbers, smaller first, no nulls and loops; of repeated edges the best score."""
    e = raw.select(whole(F.col(id1)).alias("id1"), whole(F.col(id2)).alias("id2"), *([F.col(score).try_cast("double").alias("score")] if score else []))
    if not score:
        return canonical(e)
    ends = e.where("id1 <> id2").select(F.least("id1", "id2").alias("id1"), F.greatest("id1", "id2").alias("id2"), "score")
    return ends.groupBy("id1", "id2").agg(F.max("score").alias("score"))


def members_of(text: Column) -> Column:
    """The ids of "1;2;3", "1,2" or "[1, 2, 3]"; what is no number is left out."""
    return F.array_compact(F.transform(F.split(F.regexp_replace(text, r"[\[\]\s]", ""), "[;,]"), lambda x: x.try_cast("long")))


def cluster_table(raw: DataFrame, cluster_id: str = "cluster_id", members: str = "members") -> DataFrame:
    """(cluster_id, size, members): members as an array of ids; size is their number."""
    ids = members_of(F.col(members))
    return raw.select(whole(F.col(cluster_id)).alias("cluster_id"), F.size(ids).cast("long").alias("size"), ids.alias("members"))


def named(records: DataFrame, key: str, names: DataFrame, to: str) -> DataFrame:
    """``records`` with the name of a key from a dimension (id, name); null where there is none."""
    dim = names.select(whole(F.col("id")).alias(key), clean(F.col("name")).alias(to)).dropDuplicates([key])
    return records.join(dim, key, "left")


def exists(spark: SparkSession, path: str) -> bool:
    sc = spark.sparkContext
    where = sc._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(sc._jsc.hadoopConfiguration()).exists(where)


def backends(spark: SparkSession, root: str) -> list[str]:
    """Folders under ``root`` (two levels) that hold clusters.csv or edges.csv, in any store that Spark reads."""
    sc = spark.sparkContext
    base = sc._jvm.org.apache.hadoop.fs.Path(root)
    fs = base.getFileSystem(sc._jsc.hadoopConfiguration())
    found: list[str] = []
    level = [base]
    for _ in range(3):
        below = []
        for folder in level:
            names = {s.getPath().getName(): s for s in fs.listStatus(folder)}
            if {"clusters.csv", "edges.csv"} & set(names):
                found.append(folder.toString())
            below += [s.getPath() for s in names.values() if s.isDirectory() and not s.getPath().getName().endswith(".csv")]
        level = below
    return sorted(found)
