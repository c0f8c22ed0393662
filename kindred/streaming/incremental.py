"""Structured Streaming beside the batch operators (an extension; the reference has no streams)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kindred.operators.blocking import block_sizes, token_keys


def link_stream(new: DataFrame, index: DataFrame, text: Column, path: str, checkpoint: str, id_col: str = "id", most: int = 1000) -> StreamingQuery:
    """Write (id1, id2, shared) pairs of new records and indexed ones that share a token, batch by batch.

    ``index`` holds (id, key) rows of the records known before. Blocks over ``most`` members are left
    out. A batch is written under its number, so a batch that is run again replaces itself.
    """
    fit = block_sizes(index).where(F.col("n") <= most).select("key")
    kept = index.join(fit, "key", "left_semi")

    def link(batch: DataFrame, number: int) -> None:
        keys = token_keys(batch, id_col, text).select("key", F.col("id").alias("id1"))
        met = keys.join(kept.select("key", F.col("id").alias("id2")), "key").groupBy("id1", "id2").agg(F.count("*").alias("shared"))
        met.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return new.writeStream.foreachBatch(link).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_seen(events: DataFrame, key: str, at: str, delay: str = "1 hour") -> DataFrame:
    """Events without repeats of a key; state older than the watermark is dropped."""
    return events.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def windowed_counts(events: DataFrame, at: str, by: str, width: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """(start, <by>, n): events per window and group; later than the watermark allows, they don't count."""
    w = events.withWatermark(at, delay).groupBy(F.window(at, width).alias("w"), by).agg(F.count("*").alias("n"))
    return w.select(F.col("w.start").alias("start"), by, "n")
