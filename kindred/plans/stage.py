"""Cutting lineage: a stage is written once as a Parquet table in the cluster's shared folder.

The folder is the one that ``spark.checkpoint.dir`` names. Only where the session names none (local
tests) a folder of this process is used. A written table survives lost executors and, unlike an RDD
checkpoint, keeps column pruning for its readers. A session on a cluster that names no folder is refused.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows of a file, where the number of rows is about known.
FILE_ROWS = 1 << 16

_own: dict[str, str] = {}


def stage_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if "dir" not in _own:
        _own["dir"] = "file://" + tempfile.mkdtemp(prefix="kindred-stage-")
    return _own["dir"]


def _drop(jvm, conf, path: str) -> None:
    with contextlib.suppress(Exception):
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)


def staged(df: DataFrame, name: str = "stage", rows: int | None = None) -> DataFrame:
    """Run ``df`` now, write it, and return a reader of what was written; it goes when the driver ends.

    ``rows``: about how many there are, at most. A small table is then written by fewer tasks, two for each core
    at least, not as a file for each shuffle partition: a local file system without Hadoop's native library starts
    a process (chmod) for each file, which for a moment maps all of the executor's memory a second time.
    """
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(max(2 * spark.sparkContext.defaultParallelism, -(-rows // FILE_ROWS)))
    path = f"{stage_root(spark)}/kindred/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    sc = spark.sparkContext
    atexit.register(_drop, sc._jvm, sc._jsc.hadoopConfiguration(), path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    # Shuffle files go when the JVM collects what refers to them; asking keeps the disk to living ones.
    sc._jvm.System.gc()
    return out


def release(df: DataFrame) -> None:
    """Delete a table that nothing reads any more."""
    sc = df.sparkSession.sparkContext
    _drop(sc._jvm, sc._jsc.hadoopConfiguration(), df.staged_path)


class Stages:
    """The intermediate tables of one operator: ``finish`` writes its result and deletes them."""

    def __init__(self) -> None:
        self.tables: list[DataFrame] = []

    def __call__(self, df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
        self.tables.append(staged(df, name, rows))
        return self.tables[-1]

    def finish(self, df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
        out = staged(df, name, rows)
        for t in self.tables:
            release(t)
        self.tables.clear()
        return out
