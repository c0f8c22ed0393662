"""Pairs: their records, labels, samples and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.operators.blocking import spread
from kindred.operators.ranks import comes_before, hash_rank, ordered_rank, row_at
from kindred.operators.tiles import pairs_within


def attach(pairs: DataFrame, records: DataFrame, id_col: str, cols: list[str]) -> DataFrame:
    """``pairs`` with the columns of both records, suffixed 1 and 2; a missing record leaves nulls."""
    side = lambda k: records.select(F.col(id_col).alias(f"id{k}"), *(F.col(c).alias(f"{c}{k}") for c in cols))
    return pairs.join(side(1), "id1", "left").join(side(2), "id2", "left")


def pair_texts(pairs: DataFrame, left: DataFrame, right: DataFrame, separator: str = " [SEP] ") -> DataFrame:
    """``pairs`` (ltable_id, rtable_id, ...) with left_text, right_text (empty where missing) and both as pair_text."""
    a = left.select(F.col("id").alias("ltable_id"), F.col("text").alias("left_text"))
    b = right.select(F.col("id").alias("rtable_id"), F.col("text").alias("right_text"))
    out = pairs.join(a, "ltable_id", "left").join(b, "rtable_id", "left").na.fill("", ["left_text", "right_text"])
    return out.withColumn("pair_text", F.concat("left_text", F.lit(separator), "right_text"))


def union_tables(left: DataFrame, right: DataFrame) -> DataFrame:
    """All records of two tables with _table left or right; columns that one lacks are null."""
    return left.withColumn("_table", F.lit("left")).unionByName(right.withColumn("_table", F.lit("right")), allowMissingColumns=True)


def lookup(left: DataFrame, right: DataFrame, ids: DataFrame) -> DataFrame:
    """The records of ``ids`` (id); where both tables have one, the left one's."""
    found = ids.select("id").distinct()
    first = left.join(found, "id", "left_semi")
    return union_tables(first, right.join(found, "id", "left_semi").join(first.select("id"), "id", "left_anti"))


def only(records: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    """The records whose id is among ``ids`` (id)."""
    return records.join(ids.select(F.col("id").alias(id_col)), id_col, "left_semi")


def truth_pairs(clusters: DataFrame) -> DataFrame:
    """(id1, id2): every pair of one cluster, from (id, cluster); the square of its size, by definition."""
    return pairs_within(clusters.select("id", "cluster"), ["cluster"], "id")


def n_truth_pairs(clusters: DataFrame) -> int:
    """How many ``truth_pairs`` there are, from the sizes of the clusters."""
    each = clusters.where("cluster is not null").groupBy("cluster", "id").agg(F.count("*").alias("m"))
    size = each.groupBy("cluster").agg(F.sum("m").alias("s"), F.sum(F.col("m") * F.col("m")).alias("q"))
    return int(size.agg(F.sum(F.expr("(s * s - q) div 2"))).first()[0] or 0)


def cluster_stars(clusters: DataFrame) -> DataFrame:
    """(id1, id2): each member with the smallest one of its cluster, all that components need."""
    known = clusters.where("cluster is not null")
    first = known.groupBy("cluster").agg(F.min("id").alias("id1"))
    return known.join(first, "cluster").where("id1 < id").select("id1", F.col("id").alias("id2"))


def label_pairs(candidates: DataFrame, truth: DataFrame) -> DataFrame:
    """``candidates`` with label 1 where the pair, in either order, is among ``truth``, else 0."""
    ends = lambda df: df.withColumns({"__a": F.least("id1", "id2"), "__b": F.greatest("id1", "id2")})
    true = ends(truth.select("id1", "id2")).select("__a", "__b", F.lit(1).alias("label")).distinct()
    return ends(candidates).join(true, ["__a", "__b"], "left").na.fill(0, ["label"]).drop("__a", "__b")


def captured(candidates: DataFrame, truth: DataFrame) -> DataFrame:
    """(id1, id2): candidates that are true pairs."""
    return candidates.select("id1", "id2").intersect(truth.select("id1", "id2"))


def known_pairs(candidates: DataFrame, training: DataFrame) -> DataFrame:
    """The candidates that training pairs (id1, id2, label) hold too, with their label."""
    return candidates.join(training.select("id1", "id2", "label"), ["id1", "id2"])


def positives(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    return scored.where(F.col("score") >= threshold)


def halves(records: DataFrame, id_col: str = "id") -> DataFrame:
    """``records`` with side left for the first half by id, else right."""
    n = records.count()
    return ordered_rank(records, id_col, name="__rank").withColumn("side", F.when(F.col("__rank") < n // 2, "left").otherwise("right")).drop("__rank")


def sample_share(records: DataFrame, id_: Column, share: float, seed: int = 42) -> DataFrame:
    """About a share of the records, the same ones whatever the partitioning."""
    return records.where(spread(id_, seed) < share * 2147483648)


def pair_spread(seed: int = 42) -> Column:
    """A number in [0, 2**31) that orders pairs as if at random."""
    return (F.col("id1") * 40503 + F.col("id2") * 2654435761 + seed) % 2147483648


def cap_pairs(pairs: DataFrame, most: int, seed: int = 42) -> DataFrame:
    """``most`` pairs, the first by hash: a sample of fixed size."""
    return hash_rank(pairs, pair_spread(seed), "id1", "id2", name="__rank").where(F.col("__rank") < most).drop("__rank")


def three_way(pairs: DataFrame, train: float = 0.7, val: float = 0.85, seed: int = 42) -> DataFrame:
    """``pairs`` with split: train, val or test by exact shares of a hashed order."""
    h = pair_spread(seed)
    first, second = row_at(pairs, [float(train), float(val)], h, "id1", "id2")
    before = lambda at: comes_before(at, h, "id1", "id2")
    return pairs.withColumn("split", F.when(before(first), "train").when(before(second), "val").otherwise("test"))


def head_tail(pairs: DataFrame, train: float = 0.7) -> DataFrame:
    """``pairs`` with split: the first share in the order of their ids is train, the rest test."""
    n = pairs.count()
    return ordered_rank(pairs, "id1", "id2", name="__rank").withColumn("split", F.when(F.col("__rank") < int(n * train), "train").otherwise("test")).drop("__rank")


def temporal_split(records: DataFrame, year: Column, train_before: int = 1870, test_after: int = 1900) -> DataFrame:
    """``records`` with split by year: train before, test after, val between; null years have none."""
    y = year.try_cast("int")
    return records.withColumn("split", F.when(y < train_before, "train").when(y <= test_after, "val").when(y > test_after, "test"))


def plausible_negatives(records: DataFrame, gap: float = 5, letters: int = 2) -> DataFrame:
    """(id1, id2): records of different clusters whose texts start alike and whose numbers are within ``gap``.

    From (id, text, number, cluster): a range join on the prefix and buckets of the number as wide as the gap;
    each side stands in its own bucket and meets the two next to it.
    """
    rows = records.select("id", F.substring("text", 1, letters).alias("head"), F.col("number").alias("x"), "cluster", F.floor(F.col("number") / gap).alias("w"))
    a = rows.select("head", F.col("id").alias("id1"), F.col("x").alias("x1"), F.col("cluster").alias("c1"), F.explode(F.array(F.col("w") - 1, F.col("w"), F.col("w") + 1)).alias("w"))
    b = rows.select("head", "w", F.col("id").alias("id2"), F.col("x").alias("x2"), F.col("cluster").alias("c2"))
    return a.join(b, ["head", "w"]).where((F.col("id1") < F.col("id2")) & ~F.col("c1").eqNullSafe(F.col("c2")) & (F.abs(F.col("x1") - F.col("x2")) <= gap)).select("id1", "id2")


def training_pairs(records: DataFrame, most: int = 2000, gap: float = 5, letters: int = 2, seed: int = 42) -> DataFrame:
    """(id1, id2, label): ``most`` positives by hash, and for each a negative of its first record.

    From (id, text, number, cluster). The negative is that record's plausible one that is first by hash; without
    one, the next record of another cluster in hashed order (of the next three).
    """
    truth = cap_pairs(truth_pairs(records), most, seed)
    near = plausible_negatives(records, gap, letters)
    either = near.union(near.select(F.col("id2").alias("id1"), F.col("id1").alias("id2")))
    best = either.join(truth.select("id1").distinct(), "id1", "left_semi").groupBy("id1").agg(F.min(F.struct(pair_spread(seed).alias("h"), F.col("id2").alias("other"))).alias("b"))
    n = records.count()
    place = hash_rank(records.select("id", "cluster"), spread(F.col("id"), seed), "id", name="r")
    ahead = place.select(F.col("id").alias("id1"), F.col("cluster").alias("c1"), F.posexplode(F.array(*((F.col("r") + k) % n for k in (1, 2, 3)))).alias("k", "r"))
    spare = ahead.join(place.select("r", F.col("id").alias("other"), F.col("cluster").alias("c2")), "r").where(~F.col("c1").eqNullSafe(F.col("c2")))
    spare = spare.groupBy("id1").agg(F.min(F.struct("k", "other")).alias("s"))
    negative = truth.select("id1").join(best, "id1", "left").join(spare, "id1", "left").select("id1", F.coalesce("b.other", "s.other").alias("other")).where("other is not null")
    negative = negative.select(F.least("id1", "other").alias("id1"), F.greatest("id1", "other").alias("id2"), F.lit(0).alias("label"))
    return truth.withColumn("label", F.lit(1)).unionByName(negative)


def person_pairs(clusters: DataFrame, persons: int = 2000, most: int = 50_000, seed: int = 42) -> DataFrame:
    """(id1, id2, label): all pairs of ``persons`` clusters with two or more records, and twice as many of others.

    Clusters are the first by hash. Negatives join each member to others at hashed distances in the order of
    ids; pairs of one cluster are left out, and pairs in all are no more than ``most``.
    """
    many = clusters.where("cluster is not null").groupBy("cluster").agg(F.count("*").alias("n")).where("n > 1").select("cluster")
    chosen = hash_rank(many, spread(F.col("cluster"), seed), "cluster", name="r").where(F.col("r") < persons).select("cluster")
    members = clusters.join(chosen, "cluster", "left_semi").select("id", "cluster")
    true = truth_pairs(members)
    n, pos = members.count(), n_truth_pairs(members)
    want = max(0, min(2 * pos, most - pos))
    place = ordered_rank(members, "id", name="r")
    turns = -(-want * 2 // max(1, n)) + 1
    shifts = F.transform(F.sequence(F.lit(1), F.lit(turns)), lambda k: (F.col("r") + 1 + (k * 7919 + seed) % F.lit(max(1, n - 1))) % F.lit(max(1, n)))
    ahead = place.select(F.col("id").alias("a"), F.col("cluster").alias("c1"), F.explode(F.array_distinct(shifts)).alias("r"))
    other = ahead.join(place.select("r", F.col("id").alias("b"), F.col("cluster").alias("c2")), "r").where("c1 <> c2")
    other = other.select(F.least("a", "b").alias("id1"), F.greatest("a", "b").alias("id2")).distinct()
    return true.withColumn("label", F.lit(1)).unionByName(cap_pairs(other, want, seed).withColumn("label", F.lit(0)))


def hard_negatives(candidates: DataFrame, truth: DataFrame, per_positive: int = 2, seed: int = 7) -> DataFrame:
    """(id1, id2, label): candidates that are true, and so many times as many that are not, the first by hash."""
    marked = label_pairs(candidates.select("id1", "id2"), truth)
    pos = marked.agg(F.sum("label")).first()[0] or 0
    return marked.where("label = 1").unionByName(cap_pairs(marked.where("label = 0"), per_positive * pos, seed))


def statistics(splits: DataFrame, left: DataFrame, right: DataFrame | None = None) -> DataFrame:
    """n_train, n_val and n_test pairs, n_left (and n_right) records and the share of positive training pairs, from (split, label)."""
    of = lambda s: F.count_if(F.col("split") == s)
    pos = F.avg(F.when(F.col("split") == "train", F.col("label").cast("double")))
    out = splits.agg(of("train").alias("n_train"), of("val").alias("n_val"), of("test").alias("n_test"), pos.alias("train_pos_ratio"))
    out = out.crossJoin(left.agg(F.count("*").alias("n_left")))  # one row each
    return out if right is None else out.crossJoin(right.agg(F.count("*").alias("n_right")))


def search(rows: DataFrame, cols: list[str], needle: str) -> DataFrame:
    """The rows where one of the columns holds ``needle``, in any case, as plain text."""
    hit = F.lit(False)
    for c in cols:
        hit = hit | F.coalesce(F.contains(F.lower(F.col(c).cast("string")), F.lit(needle.lower())), F.lit(False))
    return rows.where(hit)


def top_rows(rows: DataFrame, order: list[Column], n: int, rename: dict[str, str] | None = None, drop: tuple[str, ...] = ()) -> DataFrame:
    """The first ``n`` rows of an order, with columns renamed and dropped."""
    return rows.orderBy(*order).limit(n).drop(*drop).withColumnsRenamed(rename or {})


def best_per(rows: DataFrame, by: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each group."""
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("__r") <= n).drop("__r")
