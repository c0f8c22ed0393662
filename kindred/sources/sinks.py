"""What the engine writes: versions of edges and clusters, results, and pairs in the formats of other matchers."""

from __future__ import annotations

import json
import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.functions.text import clean, term
from kindred.operators.clusters import canonical
from kindred.operators.pairs import attach
from kindred.sources.tables import cluster_table, edge_table, exists, read_csv


def members_text(members: Column) -> Column:
    return F.array_join(F.transform(members, lambda x: x.cast("string")), ";")


def write_backend(edges: DataFrame, clusters: DataFrame, folder: str) -> None:
    """edges.csv (id1, id2[, score]) and clusters.csv (cluster_id, size, members) as CSV folders."""
    edges.write.csv(f"{folder}/edges.csv", header=True, mode="errorifexists")
    clusters.select("cluster_id", "size", members_text(F.col("members")).alias("members")).write.csv(f"{folder}/clusters.csv", header=True, mode="errorifexists")


def save_version(spark: SparkSession, source: str, edges: DataFrame, clusters: DataFrame, root: str, comment: str = "", name: str | None = None) -> str:
    """A new folder under ``root`` with the canonical edges, the clusters and a row of meta JSON; one that exists is an error."""
    stamp = time.strftime("%Y%m%d_%H%M%S")
    folder = f"{root}/{name or f'version_{stamp}'}"
    if exists(spark, folder):
        raise FileExistsError(folder)
    write_backend(canonical(edges), clusters, folder)
    meta = {"created_at": stamp, "source": source, "comment": comment}
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.text(f"{folder}/meta.json")
    return folder


def load_version(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, dict]:
    """Edges, clusters and meta of a saved version."""
    if not exists(spark, f"{folder}/clusters.csv"):
        raise FileNotFoundError(f"{folder}/clusters.csv")
    meta = json.loads(spark.read.text(f"{folder}/meta.json").first()[0]) if exists(spark, f"{folder}/meta.json") else {}
    return edge_table(read_csv(spark, f"{folder}/edges.csv")), cluster_table(read_csv(spark, f"{folder}/clusters.csv")), meta


def write_results(results: DataFrame, folder: str) -> None:
    """A result table as results.csv and results.json."""
    results.write.csv(f"{folder}/results.csv", header=True, mode="overwrite")
    results.write.json(f"{folder}/results.json", mode="overwrite")


def _record(cols: list[str], k: int) -> Column:
    return F.concat_ws(" ", *(F.concat(F.lit(f"COL {c} VAL "), F.coalesce(F.col(f"{c}{k}").cast("string"), F.lit(""))) for c in cols))


def ditto_lines(pairs: DataFrame, records: DataFrame, id_col: str, cols: list[str]) -> DataFrame:
    """(id1, id2, line): label, a tab, and both records as COL <name> VAL <value> ..., parted by [SEP]."""
    both = attach(pairs, records, id_col, cols)
    return both.select("id1", "id2", F.concat(F.col("label").cast("string"), F.lit("\t"), _record(cols, 1), F.lit(" [SEP] "), _record(cols, 2)).alias("line"))


def anymatch_rows(pairs: DataFrame, records: DataFrame, id_col: str, cols: list[str]) -> DataFrame:
    """(id1, id2, label, left_<column>..., right_<column>...)."""
    both = attach(pairs, records, id_col, cols)
    return both.select("id1", "id2", "label", *(F.col(f"{c}{k}").alias(f"{side}_{c}") for k, side in ((1, "left"), (2, "right")) for c in cols))


def graph_json(pairs: DataFrame, records: DataFrame, id_col: str, cols: list[str]) -> tuple[DataFrame, DataFrame]:
    """(id, json) of the records that occur, and (json) of the edges: source, target, label."""
    ends = pairs.select(F.col("id1").alias(id_col)).union(pairs.select("id2")).distinct()
    nodes = records.join(ends, id_col, "left_semi").select(F.col(id_col).alias("id"), F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("json"))
    return nodes, pairs.select(F.to_json(F.struct(F.col("id1").alias("source"), F.col("id2").alias("target"), "label")).alias("json"))


def write_zeroer(left: DataFrame, right: DataFrame | None, folder: str) -> None:
    """tableA.csv and tableB.csv (or table.csv) and metadata.txt with the names of the columns but id."""
    spark = left.sparkSession
    for df, name in ((left, "table" if right is None else "tableA"), (right, "tableB")):
        if df is not None:
            df.write.csv(f"{folder}/{name}.csv", header=True, mode="overwrite")
    names = [(c,) for c in left.columns if c != "id"]
    spark.createDataFrame(names, "value string").coalesce(1).write.text(f"{folder}/metadata.txt")


def triple_lines(texts: DataFrame) -> DataFrame:
    """(ltable_id, rtable_id, line): left text ||| right text ||| label, from ``pairs.pair_texts``."""
    label = F.coalesce(F.col("label").cast("int"), F.lit(0)).cast("string")
    return texts.select("ltable_id", "rtable_id", F.concat_ws(" ||| ", "left_text", "right_text", label).alias("line"))


def narsese_records(records: DataFrame, id_col: str, cols: list[str]) -> DataFrame:
    """(id, statement): one statement for each field that is not blank."""
    each = [F.when(clean(F.col(c).cast("string")).isNotNull(), F.concat(F.lit("<{"), F.col(id_col).cast("string"), F.lit("} --> ["), term(F.lit(c)), F.lit("_"), term(F.col(c).cast("string")), F.lit("]>. :|:"))) for c in cols]
    return records.select(F.col(id_col).alias("id"), F.explode(F.array_compact(F.array(*each))).alias("statement"))


def narsese_pairs(judged: DataFrame) -> DataFrame:
    """(id1, id2, statement): one statement for each judgment of a pair."""
    about = F.concat(F.lit("<({"), F.col("id1").cast("string"), F.lit("} * {"), F.col("id2").cast("string"), F.lit("}) --> ["), F.col("judgment"), F.lit("]>. :|:"))
    return judged.select("id1", "id2", F.explode("judgments").alias("judgment")).select("id1", "id2", about.alias("statement"))


def dot_text(edges: DataFrame, labels: DataFrame | None = None, directed: bool = False, rankdir: str = "LR", most: int = 100_000) -> DataFrame:
    """(dot): the graph of (id1, id2[, rel]) in Graphviz form, one text; graphs beyond ``most`` edges are refused."""
    n = edges.count()
    if n > most:
        raise ValueError(f"{n} edges; a drawing takes {most} at most")
    arrow = "->" if directed else "--"
    rel = F.col("rel") if "rel" in edges.columns else F.lit(None).cast("string")
    end = F.when(rel.isNull() | (rel == ""), F.lit(";")).otherwise(F.concat(F.lit(' [label="'), rel, F.lit('"];')))
    line = F.concat(F.lit('  "'), F.col("id1").cast("string"), F.lit(f'" {arrow} "'), F.col("id2").cast("string"), F.lit('"'), end)
    lines = edges.select(F.lit(1).alias("part"), F.col("id1").alias("a"), F.col("id2").alias("b"), line.alias("line"))
    if labels is not None:
        safe = F.replace(F.col("label"), F.lit('"'), F.lit('\\"'))
        named = labels.select(F.lit(0).alias("part"), F.col("id").alias("a"), F.lit(0).cast("long").alias("b"), F.concat(F.lit('  "'), F.col("id").cast("string"), F.lit('" [label="'), safe, F.lit('"];')).alias("line"))
        lines = lines.union(named)
    body = lines.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "a", "b", "line"))), lambda x: x["line"]), "\n").alias("body"))
    head = f'{"digraph" if directed else "graph"} G {{ rankdir="{rankdir}"; node [shape=box];'
    return body.select(F.concat_ws("\n", F.lit(head), F.nullif("body", F.lit("")), F.lit("}")).alias("dot"))
