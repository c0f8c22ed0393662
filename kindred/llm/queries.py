"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm.byte_bpe import encode_decode
from kindred.llm.embedding_join import embedding_links
from kindred.llm.flac import flac_column
from kindred.llm.mixing import mix_sources
from kindred.llm.ngram_jaccard import near_duplicates
from kindred.llm.pitman_yor import perplexity_scores
from kindred.llm.sharding import assign_shards
from kindred.llm.substring_dedup import remove_repeats
from kindred.llm.sql import MIXING, SHARDING, URL_FILTER
from kindred.llm.toxicity import FOLDS, toxicity
from kindred.llm.url_filter import filter_urls


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_links(_table(spark, sf_dir, "embeddings"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return encode_decode(_table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


#: (verdict, host, path) as the contract gives them.
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = filter_urls(_table(spark, sf_dir, "pages").select("page_id", "url", "html"), URL_RULES)
    return judged.select("page_id", F.col("url_host").alias("host"), F.col("url_path").alias("path"), F.col("url_rule").alias("rule"), F.col("url_verdict").alias("verdict"))


def op4_pitman_yor_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7
    scored = perplexity_scores(_table(spark, sf_dir, "documents"), fold != 2)
    return scored.select("doc_id", (~F.col("trained")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


SHARDS = 8


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    placed = assign_shards(rows, F.col("doc_id"), SHARDS, tie=(F.col("text_crc32"), F.col("size")))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "ring_shard", "hops")


def op6_flac_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flac_column(_table(spark, sf_dir, "documents"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels"))
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS
    return scored.select("doc_id", (fold == 0).alias("held_out"), F.col("tox_score").alias("score"), F.col("tox_predicted").alias("predicted"))


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


#: Target weights of the sources in the corpus; all others have weight 1.
SOURCE_WEIGHTS = {"src0": 3.5, "src1": 2.25, "src2": 1.5, "src3": 0.7, "src4": 0.35}


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_table(spark, sf_dir, "documents").select("doc_id", "source"), SOURCE_WEIGHTS)


QUERIES = {f.__name__: f for f in (op1_embedding_near_dedup, op2_byte_bpe, op3_url_filter, op4_pitman_yor_scores, op5_sharding, op6_flac_media, op7_substring_dedup, op8_toxicity, op9_ngram_jaccard_join, op10_mixing)}
ORACLE_SQL: dict[str, str] = {
    "op3_url_filter": URL_FILTER.format(rules=", ".join(str(r) for r in URL_RULES)),
    "op5_sharding": SHARDING(SHARDS),
    "op10_mixing": MIXING(SOURCE_WEIGHTS),
}
