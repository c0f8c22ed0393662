"""A training-data pipeline over documents: each stage applies one operator to all that its predecessor kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kindred.llm.byte_bpe import encode_decode
from kindred.llm.mixing import mix_sources
from kindred.llm.ngram_jaccard import near_duplicates
from kindred.llm.queries import SOURCE_WEIGHTS
from kindred.llm.substring_dedup import remove_repeats, row_key
from kindred.llm.toxicity import toxicity
from kindred.plans.stage import staged

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity(docs, labels).where("tox_predicted = 0").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays; rows without an id stay."""
    gone = near_duplicates(docs).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the repeated passages; a text that was all repeated stays as an empty one."""
    changed = remove_repeats(docs).where("n_removed > 0").select("a", "b", F.col("kept").alias("left")).dropDuplicates(["a", "b"])
    a, b = row_key(F.col("doc_id"), F.col("text"))
    out = docs.withColumns({"a": a, "b": b}).join(changed, ["a", "b"], "left")
    n = F.when(F.col("left").isNull(), F.col("n_chars")).otherwise(F.char_length("left").cast("long"))
    return out.withColumns({"text": F.coalesce("left", "text"), "n_chars": n}).select(*docs.columns)


def interleave(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows in the order of the schedule: files, in the order of their names, and rows within files follow it."""
    mixed = mix_sources(docs, SOURCE_WEIGHTS)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return mixed.repartitionByRange(parts, "mix_position").sortWithinPartitions("mix_position").select(*docs.columns)


def with_position(docs: DataFrame) -> DataFrame:
    """``docs`` with mix_position, the place of each row in the written order of its files; null if ``docs`` reads no files.

    One count a file meets the rows; no row is moved.
    """
    try:
        rows = docs.select("*", F.col("_metadata.file_name").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    except AnalysisException:
        return docs.withColumn("mix_position", F.lit(None).cast("long"))
    files = rows.groupBy("__file").agg(F.count("*").alias("__n"))
    before = files.select("__file", (F.sum("__n").over(Window.orderBy("__file")) - F.col("__n")).alias("__before"))
    return rows.join(before, "__file").withColumn("mix_position", F.col("__before") + F.col("__row")).drop("__file", "__row", "__before")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every document, with its place in the mix."""
    kept = (*(c for c in docs.columns if c not in ("doc_id", "text")), "mix_position")
    return encode_decode(with_position(docs), VOCABULARY, public_tokenizers.PATTERN, keep=kept, with_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("substring_dedup", cut_repeats),
    ("mixing", interleave),
    ("byte_bpe", encode),
]

#: No stage of this pipeline is expressible in SQL; tests/llm/test_pipeline.py holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
