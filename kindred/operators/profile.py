"""Dataset profiles: coverage, missing values, cluster sizes, ambiguity of names, numeric summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.functions.text import clean
from kindred.operators.ranks import quantiles

#: The families of census fields, and the rows of the reports.
FAMILIES = {
    "names": ["nafn_norm", "first_name", "patronym", "surname"],
    "demographics": ["birthyear", "sex", "status", "marriagestatus"],
    "geography": ["farm", "parish", "district", "county"],
    "kinship": ["partner", "father", "mother"],
}
TOP_NAMES, TOP_SHARE, CCDF_POINTS = 100, 10, 50


def coverage(records: DataFrame, wave: Column, label: Column) -> DataFrame:
    """(wave, n_records, n_labelled, rate) per wave and, with a null wave, in all; rate in percent, two digits."""
    n = records.where(wave.isNotNull()).groupBy(wave.alias("wave")).agg(F.count("*").alias("n_records"), F.count(label).alias("n_labelled"))
    both = n.union(n.agg(F.lit(None).cast(n.schema["wave"].dataType).alias("wave"), F.sum("n_records"), F.sum("n_labelled")))
    return both.withColumn("rate", F.coalesce(F.round(100.0 * F.try_divide(F.col("n_labelled"), F.col("n_records")), 2), F.lit(0.0)))


def distinct_labels(records: DataFrame, label: Column) -> DataFrame:
    """(n_distinct): clusters that occur; counted by a hash aggregate, exact."""
    return records.agg(F.count_distinct(label).alias("n_distinct"))


def missing_by_family(records: DataFrame, wave: str, families: dict[str, list[str]] | None = None) -> DataFrame:
    """(family, wave, rate) per family and wave, and over all waves (null): percent of blank or null values, two digits.

    One pass counts the blanks of each family; the long form comes from a row a wave.
    """
    families = families or FAMILIES
    blank = lambda cols: sum((F.when(clean(F.col(c).cast("string")).isNull(), 1).otherwise(0) for c in cols[1:]), F.when(clean(F.col(cols[0]).cast("string")).isNull(), 1).otherwise(0))
    n = records.where(F.col(wave).isNotNull()).rollup(F.col(wave).alias("wave")).agg(F.count("*").alias("n"), *(F.sum(blank(cols)).alias(f) for f, cols in families.items()))
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("family"), F.col(f).alias("m"), F.lit(len(cols)).alias("k")) for f, cols in families.items())))
    return n.select("wave", "n", each.alias("x")).select("x.family", "wave", F.round(100.0 * F.col("x.m") / (F.col("n") * F.col("x.k")), 2).alias("rate"))


def _size_counts(members: DataFrame, cluster: str) -> DataFrame:
    return members.where(F.col(cluster).isNotNull()).groupBy(cluster).agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("n"))


def size_report(members: DataFrame, cluster: str) -> DataFrame:
    """(n_clusters, median_size, p95_size, max_size, n_multiple): whole numbers, quantiles cut off."""
    by = _size_counts(members, cluster)
    end = by.select("size", "n", F.sum("n").over(Window.orderBy("size")).alias("end"))  # a row a size
    total = by.agg(F.sum("n").alias("total"))
    marks = end.crossJoin(F.broadcast(total))
    at = lambda rank: F.min(F.when(F.col("end") > rank, F.col("size")))
    spot = {q: F.lit(q) * (F.col("total") - 1) for q in (0.5, 0.95)}
    got = marks.groupBy("total").agg(*(at(f(spot[q])).alias(f"{n}{int(q * 100)}") for q in spot for f, n in ((F.floor, "lo"), (F.ceil, "hi"))), F.max("size").alias("max_size"), F.sum(F.when(F.col("size") > 1, F.col("n")).otherwise(0)).alias("n_multiple"))
    whole = lambda q: (F.col(f"lo{int(q * 100)}") + (F.col(f"hi{int(q * 100)}") - F.col(f"lo{int(q * 100)}")) * (spot[q] - F.floor(spot[q]))).cast("long")
    return got.select(F.col("total").alias("n_clusters"), whole(0.5).alias("median_size"), whole(0.95).alias("p95_size"), "max_size", "n_multiple")


def size_ccdf(members: DataFrame, cluster: str, points: int = CCDF_POINTS) -> DataFrame:
    """(size, n, share): how many clusters have a size, and the share of at least that; the smallest ``points`` sizes."""
    by = _size_counts(members, cluster)
    up = Window.orderBy(F.col("size").desc())  # a row a size
    total = F.sum("n").over(Window.partitionBy())
    return by.select("size", "n", (F.sum("n").over(up) / total).alias("share")).orderBy("size").limit(points)


def name_counts(records: DataFrame, name: Column) -> DataFrame:
    """(name, n) of the names that are not blank, trimmed and lower-cased."""
    return records.select(clean(F.lower(name)).alias("name")).where("name is not null").groupBy("name").agg(F.count("*").alias("n"))


def top_names(records: DataFrame, name: Column, most: int = TOP_NAMES) -> DataFrame:
    """(name, n): the commonest names, in order of names among equals."""
    return name_counts(records, name).orderBy(F.col("n").desc(), "name").limit(most)


def name_ambiguity(records: DataFrame, name: Column) -> DataFrame:
    """(n_names, n_records, entropy, effective_names, top_share): entropy in bits, two to its power, and the percent of the TOP_SHARE commonest."""
    n = name_counts(records, name)
    total = n.agg(F.sum("n").alias("total"))
    p = F.col("n") / F.col("total")
    sums = n.crossJoin(F.broadcast(total)).agg(F.count("*").alias("n_names"), F.max("total").alias("n_records"), (-F.sum(p * F.log2(p + 1e-10))).alias("entropy"))
    top = n.orderBy(F.col("n").desc(), "name").limit(TOP_SHARE).agg(F.sum("n").alias("top"))
    return sums.crossJoin(top).select("n_names", "n_records", "entropy", F.pow(F.lit(2.0), F.col("entropy")).alias("effective_names"), (100.0 * F.col("top") / F.col("n_records")).alias("top_share"))


def describe_numeric(records: DataFrame, value: str, by: list[str]) -> DataFrame:
    """(*by, n, mean, std, low, q1, median, q3, high): sample deviation, quantiles with linear interpolation."""
    base = records.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("low"), F.max(value).alias("high"))
    q = quantiles(records, value, [0.25, 0.5, 0.75], by)
    wide = q.groupBy(*by).agg(*(F.max(F.when(F.col("q") == p, F.col("x"))).alias(name) for p, name in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))))
    return base.join(wide, by, "left").select(*by, "n", "mean", "std", "low", "q1", "median", "q3", "high")


def null_correlation(records: DataFrame, cols: list[str]) -> DataFrame:
    """(a, b, corr): correlation of being null for each two columns, a before b; null where one never or always is."""
    flag = lambda c: F.col(c).isNull().cast("double")
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1 :]]
    one = records.agg(*(F.when((F.stddev_pop(flag(a)) > 0) & (F.stddev_pop(flag(b)) > 0), F.corr(flag(a), flag(b))).alias(f"c{i}") for i, (a, b) in enumerate(pairs)))
    return one.select(F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{i}").alias("corr")) for i, (a, b) in enumerate(pairs)))).alias("x")).select("x.*")


def synopsis(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, n_rows, n_columns, columns): one row per table, columns joined in order."""
    out = None
    for name, df in tables.items():
        row = df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("name"), "n_rows", F.lit(len(df.columns)).cast("long").alias("n_columns"), F.lit(", ".join(df.columns)).alias("columns"))
        out = row if out is None else out.union(row)
    return out
