"""What the catalogues share: registration, tables, and the census-like records made from ``part``.

The record expressions are plain SQL that both engines read, so query and oracle start from one text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.operators.tiles import by_values, pairs_within

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL where SQL can express it."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def rounded(x: Column | str, name: str, digits: int = 6) -> Column:
    return F.round(x if isinstance(x, Column) else F.col(x), digits).alias(name)


_FATHER = "CAST(floor(p_partkey / 2.0) AS BIGINT)"
PEOPLE = {
    "id": "p_partkey",
    "heimild": "CAST(1850 + 10 * (p_partkey % 8) AS BIGINT)",
    "nafn_norm": "p_name",
    "first_name": "split_part(p_name, ' ', 1)",
    "middle_name": "CAST(NULL AS VARCHAR(9))",
    "patronym": "split_part(p_name, ' ', 2)",
    "surname": "CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE lower(p_brand) END",
    "birthyear": "CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE CAST(1800 + p_size AS BIGINT) END",
    "sex": "CASE WHEN p_partkey % 7 < 3 THEN 'kona' ELSE 'karl' END",
    "status": "lower(p_type)",
    "marriagestatus": "CASE WHEN p_partkey % 5 = 0 THEN NULL WHEN p_size > 25 THEN 'g' ELSE 'o' END",
    "person": "CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE p_partkey % 700 END",
    "partner": "CASE WHEN p_partkey % 4 = 0 THEN NULL WHEN p_partkey % 97 = 0 THEN p_partkey ELSE p_partkey + 1 - 2 * (p_partkey % 2) END",
    "father": f"CASE WHEN p_partkey < 2 THEN NULL ELSE {_FATHER} END",
    "mother": f"CASE WHEN p_partkey < 3 OR p_partkey % 6 = 0 THEN NULL WHEN p_partkey % 101 = 0 THEN {_FATHER} ELSE CAST(floor(p_partkey / 3.0) AS BIGINT) END",
    "farm": "CAST(p_size AS BIGINT)",
    "county": "CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE CAST(p_size % 4 AS BIGINT) END",
    "parish": "CAST(p_size % 10 AS BIGINT)",
    "district": "CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE CAST(p_size % 20 AS BIGINT) END",
}
PEOPLE_SQL = "people AS (SELECT " + ", ".join(f"{e} AS {c}" for c, e in PEOPLE.items()) + " FROM part)"


def people(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").selectExpr(*(f"{e} AS {c}" for c, e in PEOPLE.items()))


#: Pairs of records of one status and farm; equal full names are the label.
PAIRS_SQL = f"{PEOPLE_SQL}, pr AS (SELECT a.id AS id1, b.id AS id2, CASE WHEN a.nafn_norm = b.nafn_norm THEN 1 ELSE 0 END AS label FROM people a JOIN people b ON a.status = b.status AND a.farm = b.farm AND a.id < b.id)"


def people_pairs(spark: SparkSession, d: str, fields: list[str] | None = None) -> DataFrame:
    """(id1, id2, label) and ``fields`` of both records, suffixed 1 and 2."""
    return met_people(people(spark, d), fields or []).select("id1", "id2", "label", *(f"{f}{k}" for f in fields or [] for k in (1, 2)))


def met_people(records: DataFrame, fields: list[str]) -> DataFrame:
    """The pairs of records made from ``people``, whose fields travel with them: no pair is joined to its records."""
    met = pairs_within(records, ["status", "farm"], "id", list(dict.fromkeys(["nafn_norm", *fields])))
    return met.withColumn("label", F.coalesce((F.col("nafn_norm1") == F.col("nafn_norm2")).cast("int"), F.lit(0)))


def compared_people(records: DataFrame, results: dict) -> tuple[DataFrame, dict]:
    """(id1, id2, label) of the pairs, and columns for results of one field's two values each: {field: {name: of}}."""
    carried, found = [], {}
    for field, of in {"nafn_norm": {}, **results}.items():
        same = {"label": lambda x, y: F.coalesce((x == y).cast("int"), F.lit(0))} if field == "nafn_norm" else {}
        records, col, got = by_values(records, field, {**same, **of})
        carried.append(col)
        found |= got
    met = pairs_within(records, ["status", "farm"], "id", carried)
    return met.withColumn("label", found.pop("label")), found


def both_sql(fields: list[str]) -> str:
    """A CTE ``bp``: the pairs with fields of both records, suffixed 1 and 2."""
    cols = ", ".join(f"a.{f} AS {f}1, b.{f} AS {f}2" for f in fields)
    return f"{PAIRS_SQL}, bp AS (SELECT id1, id2, label, {cols} FROM pr LEFT JOIN people a ON a.id = id1 LEFT JOIN people b ON b.id = id2)"
