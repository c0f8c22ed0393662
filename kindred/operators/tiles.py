"""Pairs of records within blocks, when the pairs are many more than the records.

A block is cut into runs of TILE records in the order of their ids, and each two runs of it meet in a tile of their own, so
neither the largest block nor a small file decides how the pairs are dealt: a tile is at most TILE**2 pairs,
and there are as many tasks as the number of pairs asks for. A record travels once for each run of its block.
What a comparison needs of a record is computed before (``cols``), not pair by pair.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

#: Records of a run.
TILE = 1024
#: Pairs expected of a task, and the most tasks.
PAIRS_A_TASK, MOST_TASKS = 1 << 20, 1 << 14


def _runs(records: DataFrame, by: list[str], id_col: str, size: int) -> DataFrame:
    """``records`` without null keys, with the number of their run and of the last one of their block."""
    known = records
    for c in by:
        known = known.where(F.col(c).isNotNull())
    block = Window.partitionBy(*by)
    place = F.row_number().over(block.orderBy(id_col)) - 1
    last = F.floor((F.count("*").over(block) - 1) / size).cast("int")
    return known.withColumns({"__run": F.floor(place / size).cast("int"), "__last": last})


def tasks_for(records: DataFrame, by: list[str]) -> int:
    """The number of tasks for the pairs of the blocks, from the blocks' sizes."""
    n = F.col("count").cast("double")
    pairs = records.groupBy(*by).count().agg(F.sum(n * (n - 1) / 2)).first()[0] or 0
    return int(min(MOST_TASKS, max(1, pairs // PAIRS_A_TASK)))


def dealt(df: DataFrame, rows: int = 1 << 16) -> DataFrame:
    """``df`` in parts of about so many rows: a compressed file is one task's, however long its rows take."""
    n = df.count()
    return df.repartition(min(MOST_TASKS, -(-n // rows))) if n > rows else df


def pairs_within(records: DataFrame, by: list[str], id_col: str, cols: list[str] | None = None, size: int = TILE) -> DataFrame:
    """(id1, id2, then each of ``cols`` suffixed 1 and 2) of each two records, id1 < id2, that are equal in all of ``by``."""
    cols = cols or []
    # The size of a block takes its keys only; what is compared is not computed for it.
    n = tasks_for(records.select(*by), by)
    rows = _runs(records.select(*dict.fromkeys([*by, id_col, *cols])), by, id_col, size)
    side = lambda k, tile: rows.select(*(F.col(c).alias(f"__by{i}") for i, c in enumerate(by)), *tile, F.col(id_col).alias(f"id{k}"), *(F.col(c).alias(f"{c}{k}") for c in cols))
    keys = [*(f"__by{i}" for i in range(len(by))), "__i", "__j"]
    run, last = F.col("__run"), F.col("__last")
    left = side(1, [run.alias("__i"), F.explode(F.sequence(run, last)).alias("__j")]).repartition(n, *keys)
    right = side(2, [F.explode(F.sequence(F.lit(0), run)).alias("__i"), run.alias("__j")]).repartition(n, *keys)
    met = left.hint("merge").join(right, keys).where("id1 < id2")
    return met.select("id1", "id2", *(f"{c}{k}" for c in cols for k in (1, 2)))



#: Distinct values of a field whose pairs are compared beforehand.
FEW_VALUES = 256


def by_values(records: DataFrame, field: str, results: dict[str, Callable[[Column, Column], Column]]) -> tuple[DataFrame, str, dict[str, Column]]:
    """``records`` ready for ``pairs_within``, the column that it has to carry, and the results as columns of its pairs.

    A result depends on the two values of one field only. Where the field has no more than FEW_VALUES distinct values, all
    pairs of them (and null) are compared once, and a pair of records looks its result up by its values' numbers. Otherwise
    the values travel and each pair is compared.
    """
    known = [r[0] for r in records.where(F.col(field).isNotNull()).select(field).distinct().limit(FEW_VALUES + 1).collect()]
    if len(known) > FEW_VALUES:
        return records, field, {name: of(F.col(f"{field}1"), F.col(f"{field}2")) for name, of in results.items()}
    n, kind = len(known) + 1, records.schema[field].dataType
    values = records.sparkSession.createDataFrame([(i, v) for i, v in enumerate([None, *sorted(known)])], StructType([StructField("c", IntegerType()), StructField("v", kind)]))
    both = values.select(F.col("c").alias("c1"), F.col("v").alias("v1")).crossJoin(values.select(F.col("c").alias("c2"), F.col("v").alias("v2")))
    made = both.select("c1", "c2", *(of(F.col("v1"), F.col("v2")).alias(name) for name, of in results.items()))
    rows = sorted(made.collect(), key=lambda r: (r["c1"], r["c2"]))
    code, place = f"__{field}", F.col(f"__{field}1") * n + F.col(f"__{field}2") + 1
    at = lambda name: F.element_at(F.from_json(F.lit(json.dumps([r[name] for r in rows])), ArrayType(made.schema[name].dataType)), place)
    numbers = F.create_map(*(F.lit(x) for i, v in enumerate(sorted(known)) for x in (v, i + 1))) if known else None
    numbered = F.lit(0) if numbers is None else F.coalesce(F.element_at(numbers, F.col(field)), F.lit(0))
    return records.withColumn(code, numbered), code, {name: at(name) for name in results}
