"""Queries of clusterings, graph views, evaluation and profiles, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.operators import clusters, evaluation, graph, linkage, pairs, profile, scoring
from kindred.plans.linkage_catalogue import _EDGES, _KNOWN, _RULED, _edges, _known, _ruled
from kindred.plans.shared import PAIRS_SQL, PEOPLE_SQL, people, people_pairs, query, rounded, table
from kindred.plans.stage import staged

#: A sparse scored graph: records of neighbouring keys, scores by arithmetic that both engines share.
_SPARSE = "ed AS (SELECT c_custkey AS id1, c_custkey + 1 + c_nationkey AS id2, (c_custkey * 37 % 100) / 100.0 AS score FROM customer), nd AS (SELECT c_custkey AS id FROM customer)"


def _sparse(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    c = table(spark, d, "customer")
    edges = c.select(F.col("c_custkey").alias("id1"), (F.col("c_custkey") + 1 + F.col("c_nationkey")).alias("id2"), (F.col("c_custkey") * 37 % 100 / 100.0).cast("double").alias("score"))
    return edges.join(c.select(F.col("c_custkey").alias("id2")), "id2", "left_semi").select("id1", "id2", "score"), c.select(F.col("c_custkey").alias("id"))


def _reach(where: str, source: str = "ed") -> str:
    return f"k AS (SELECT id1, id2 FROM {source} WHERE {where}), both_ AS (SELECT id1 AS a, id2 AS b FROM k UNION SELECT id2, id1 FROM k), reach AS (SELECT a, a AS b FROM both_ UNION SELECT r.a, x.b FROM reach r JOIN both_ x ON r.b = x.a), comp AS (SELECT a AS id, min(b) AS c FROM reach GROUP BY 1)"


@query(f"WITH RECURSIVE {_SPARSE}, {_reach('score >= 0.6 AND id2 IN (SELECT id FROM nd)')} SELECT id, coalesce(c, -1) AS cluster_id FROM nd LEFT JOIN comp USING (id)")
def thresholded_components(spark, d):
    edges, nodes = _sparse(spark, d)
    return graph.thresholded_components(edges, nodes, 0.6, isolated=-1)


@query(f"WITH RECURSIVE {_SPARSE}, {_reach('score >= 0.5 AND id2 IN (SELECT id FROM nd)')} SELECT id, coalesce(c, id) AS cluster_id FROM nd LEFT JOIN comp USING (id)")
def hac_single(spark, d):
    edges, nodes = _sparse(spark, d)
    return graph.hierarchical_clusters(edges, nodes, 0.5, "single")


@query()
def hac_clusters(spark, d):
    """Average linkage; tested against a plain version."""
    edges, nodes = _sparse(spark, d)
    return graph.hierarchical_clusters(edges, nodes, 0.5)


@query()
def hac_complete(spark, d):
    edges, nodes = _sparse(spark, d)
    return graph.hierarchical_clusters(edges, nodes, 0.5, "complete")


@query(f"WITH RECURSIVE {PAIRS_SQL}, few AS (SELECT * FROM pr WHERE id1 % 10 = 0), {_reach('label = 1', 'few')} SELECT id, c AS cluster FROM comp")
def truth_components(spark, d):
    return graph.truth_clusters(people_pairs(spark, d).where("id1 % 10 = 0"))


_ARI = "x AS (SELECT sum(n * (n - 1) / 2.0) AS sij FROM c), y AS (SELECT sum(np * (np - 1) / 2.0) AS sp FROM p), v AS (SELECT sum(nt * (nt - 1) / 2.0) AS st FROM t), z AS (SELECT sum(n) AS total FROM c)"


@query(
    f"WITH RECURSIVE {_SPARSE}, {_reach('score >= 0.8 AND id2 IN (SELECT id FROM nd)')}, e AS (SELECT comp.c AS pred, c_nationkey AS tr FROM comp JOIN customer ON c_custkey = id), c AS (SELECT pred, tr, count(*) AS n FROM e GROUP BY 1, 2), p AS (SELECT pred, sum(n) AS np FROM c GROUP BY 1), t AS (SELECT tr, sum(n) AS nt FROM c GROUP BY 1), {_ARI} SELECT round((sij - sp * st / (total * (total - 1) / 2.0)) / ((sp + st) / 2 - sp * st / (total * (total - 1) / 2.0)), 6) AS ari FROM x, y, v, z"
)
def pairs_ari(spark, d):
    edges, _ = _sparse(spark, d)
    found = graph.pairs_clusters(edges, 0.8)
    true = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("true"))
    return evaluation.clustering_metrics(found.withColumnRenamed("cluster_id", "pred").join(true, "id")).select(rounded("ari", "ari"))


@query(f"WITH {_EDGES}, dg AS (SELECT id, count(*) AS degree FROM (SELECT id1 AS id FROM e UNION ALL SELECT id2 FROM e) GROUP BY 1), top AS (SELECT id FROM dg ORDER BY degree DESC, id LIMIT 150) SELECT id1, id2 FROM e WHERE id1 IN (SELECT id FROM top) AND id2 IN (SELECT id FROM top)")
def degree_prune(spark, d):
    return graph.pruned_edges(_edges(spark, d), 200, 150)


@query(f"WITH {_EDGES}, dg AS (SELECT id, count(*) AS degree FROM (SELECT id1 AS id FROM e UNION ALL SELECT id2 FROM e) GROUP BY 1) SELECT id, degree FROM dg ORDER BY degree DESC, id LIMIT 50")
def degree_top(spark, d):
    return evaluation.degree_top_k(clusters.canonical(_edges(spark, d)), 50)


_KIN = f"{PEOPLE_SQL}, raw AS (SELECT father AS src, id AS dst, 'father' AS rel FROM people UNION SELECT mother, id, 'mother' FROM people UNION SELECT id, partner, 'partner' FROM people UNION SELECT partner, id, 'partner' FROM people), kin AS (SELECT * FROM raw WHERE src IN (SELECT id FROM people) AND dst IN (SELECT id FROM people))"


@query(f"WITH {_KIN} SELECT src, dst, rel FROM kin")
def kin_edges(spark, d):
    return graph.kin_edges(people(spark, d))


@query(f"WITH {PEOPLE_SQL}, f AS (SELECT father AS id, array_to_string(list(id ORDER BY id), ',') AS k FROM people GROUP BY 1), m AS (SELECT mother AS id, array_to_string(list(id ORDER BY id), ',') AS k FROM people GROUP BY 1) SELECT p.id, coalesce(f.k, '') AS father_of, coalesce(m.k, '') AS mother_of, partner FROM people p LEFT JOIN f ON f.id = p.id LEFT JOIN m ON m.id = p.id")
def kin_index(spark, d):
    k = graph.kin_index(people(spark, d))
    return k.select("id", F.array_join("father_of", ",").alias("father_of"), F.array_join("mother_of", ",").alias("mother_of"), "partner")


@query(f"WITH RECURSIVE {_KIN}, step AS (SELECT src AS a, dst AS b FROM kin UNION SELECT dst, src FROM kin), walk AS (SELECT id, 0 AS depth FROM people WHERE id IN (3, 40) UNION SELECT b, depth + 1 FROM walk JOIN step ON a = id WHERE depth < 3) SELECT id, min(depth) AS depth FROM walk GROUP BY 1")
def kin_bfs(spark, d):
    p = people(spark, d)
    return graph.family_members(p, p.where("id in (3, 40)"), 3, 100_000)


@query(f"WITH RECURSIVE {_KIN}, step AS (SELECT src AS a, dst AS b FROM kin UNION SELECT dst, src FROM kin), walk AS (SELECT id, 0 AS depth FROM people WHERE id IN (3, 40) UNION SELECT b, depth + 1 FROM walk JOIN step ON a = id WHERE depth < 2), inner_ AS (SELECT id FROM walk GROUP BY 1 HAVING min(depth) < 2) SELECT src, dst, rel FROM kin WHERE src IN (SELECT id FROM inner_) OR dst IN (SELECT id FROM inner_)")
def kin_bfs_edges(spark, d):
    p = people(spark, d)
    return graph.family_edges(p, graph.family_members(p, p.where("id in (3, 40)"), 2, 100_000))


@query(f"WITH {PEOPLE_SQL}, i AS (SELECT id, concat_ws(', ', CASE WHEN father = mother THEN 'same_parent_id_in_both_columns' END, CASE WHEN partner = id THEN 'self_partner' END) AS issues FROM people) SELECT id, issues FROM i WHERE issues <> ''")
def dq_flags(spark, d):
    return graph.quality_flags(people(spark, d))


@query(f"WITH {PEOPLE_SQL}, g AS (SELECT id, coalesce(CAST(county AS VARCHAR), 'Unknown') AS grp FROM people) SELECT id, grp, dense_rank() OVER (ORDER BY grp) - 1 AS band FROM g")
def node_groups(spark, d):
    return graph.node_groups(people(spark, d), "county")


@query("WITH c AS (SELECT o_custkey AS cluster_id, o_orderkey AS id, count(*) OVER (PARTITION BY o_custkey) AS size FROM orders) SELECT id, cluster_id, size FROM c WHERE id % 100 = 7")
def cluster_lookup(spark, d):
    o = table(spark, d, "orders")
    wide = o.groupBy(F.col("o_custkey").alias("cluster_id")).agg(F.collect_list("o_orderkey").alias("members"))
    return graph.cluster_of(wide, o.where("o_orderkey % 100 = 7").select(F.col("o_orderkey").alias("id")))


def _marks(spark: SparkSession, d: str) -> DataFrame:
    at = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("at")
    return table(spark, d, "lineitem").select((F.col("l_suppkey") % 20).alias("cluster_id"), F.col("l_partkey").alias("id1"), F.col("l_suppkey").alias("id2"), F.when(F.col("l_returnflag") == "R", "wrong").otherwise("right").alias("status"), at)


@query("WITH r AS (SELECT l_suppkey % 20 AS cluster_id, least(l_partkey, l_suppkey) || '_' || greatest(l_partkey, l_suppkey) AS edge, l_orderkey * 10 + l_linenumber AS given, CASE WHEN l_returnflag = 'R' THEN 'wrong' ELSE 'right' END AS status FROM lineitem), m AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY cluster_id, edge ORDER BY given DESC, status DESC) = 1) SELECT cluster_id, status, count(*) AS n FROM m GROUP BY 1, 2")
def edge_feedback(spark, d):
    return graph.feedback_summary(_marks(spark, d))


_NOISE = "l AS (SELECT CASE WHEN c_custkey % 10 = 0 THEN -1 ELSE c_nationkey END AS pred, CASE WHEN c_custkey % 15 = 0 THEN -1 ELSE c_nationkey // 5 END AS tr FROM customer)"


def _noise(spark: SparkSession, d: str) -> DataFrame:
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    return table(spark, d, "customer").select(F.when(k % 10 == 0, -1).otherwise(n).alias("pred"), F.when(k % 15 == 0, -1).otherwise(F.floor(n / 5)).alias("true"))


@query(f"WITH {_NOISE}, p AS (SELECT pred, count(*) AS np FROM l WHERE pred >= 0 GROUP BY 1), t AS (SELECT tr, count(*) AS nt FROM l WHERE tr >= 0 GROUP BY 1), c AS (SELECT pred, tr, count(*) AS n FROM l WHERE pred >= 0 AND tr >= 0 GROUP BY 1, 2), s AS (SELECT sum(n * n / CAST(np AS DOUBLE)) / (SELECT count(*) FROM l WHERE tr >= 0) AS p, sum(n * n / CAST(nt AS DOUBLE)) / (SELECT count(*) FROM l WHERE tr >= 0) AS r FROM c JOIN p USING (pred) JOIN t USING (tr)) SELECT round(p, 6) AS b3_precision, round(r, 6) AS b3_recall, round(2 * p * r / (p + r), 6) AS b3_f1 FROM s")
def b3_noise(spark, d):
    return evaluation.b_cubed_with_noise(_noise(spark, d)).select(*(rounded(c, c) for c in ("b3_precision", "b3_recall", "b3_f1")))


@query(f"WITH {_NOISE}, n AS (SELECT count(*) FILTER (WHERE pred - 1 < -1) AS pb, count(*) FILTER (WHERE tr < -1) AS tb FROM l) SELECT pb = 0 AND tb = 0 AS valid, concat_ws(', ', CASE WHEN pb > 0 THEN 'pred_ids_below_minus_1' END, CASE WHEN tb > 0 THEN 'true_ids_below_minus_1' END) AS issues FROM n")
def clustering_validation(spark, d):
    return evaluation.clustering_issues(_noise(spark, d).withColumn("pred", F.col("pred") - 1))


@query(
    f"WITH {_RULED}, cl AS (SELECT p_partkey AS id, p_size AS cluster_id FROM part), tr AS (SELECT p_partkey AS id, p_partkey % 50 AS cluster FROM part WHERE p_partkey % 2 = 0), y AS (SELECT *, CASE WHEN score >= 0.5 THEN 1 ELSE 0 END AS pred FROM sc)"
    " SELECT count(*) FILTER (WHERE label = 1) > 0 AS has_positive_labels, count(*) FILTER (WHERE label = 0) > 0 AS has_negative_labels, count(*) > 0 AS labels_not_empty, sum(pred) > 0 AS has_positive_preds, sum(1 - pred) > 0 AS has_negative_preds, min(pred) <> max(pred) AS preds_not_all_same, stddev_pop(score) > 1e-10 AS scores_not_constant, min(score) >= -100 AND max(score) <= 100 AS scores_in_valid_range, true AS pair_symmetry_consistent,"
    " (SELECT count(DISTINCT cluster) > 0 FROM tr) AS true_clusters_not_empty, (SELECT count(DISTINCT cluster) > 1 FROM tr) AS true_multiple_clusters, (SELECT count(*) > 0 FROM cl) AS pred_clusters_not_empty, true AS pred_no_empty_clusters, (SELECT count(*) = count(DISTINCT id) FROM cl) AS pred_no_duplicate_members, true AS label_universe_overlap, (SELECT count(*) FROM tr) / (SELECT CAST(count(*) AS DOUBLE) FROM cl) > 0.5 AS label_universe_match_ratio, (SELECT count(*) FROM tr) / (SELECT CAST(count(*) AS DOUBLE) FROM cl) > 0.5 AS all_passed FROM y"
)
def sanity(spark, d):
    scored = _ruled(spark, d).withColumn("prediction", (F.col("score") >= 0.5).cast("int"))
    part = table(spark, d, "part")
    true = part.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 50).alias("cluster"))
    return evaluation.sanity_checks(scored, part.select(F.col("p_partkey").alias("id"), F.col("p_size").alias("cluster_id")), true)


_W = "(k / n + 1.9208 / n {0} 1.96 * sqrt(k / n * (1 - k / n) / n + 0.9604 / (n * n))) / (1 + 3.8416 / n)"


@query(
    f"WITH {_KNOWN}, b AS (SELECT doc_id AS id1, doc_id + 3 AS id2 FROM documents WHERE doc_id + 3 IN (SELECT doc_id FROM documents)), s AS (SELECT id1, id2, (x.label IS NOT NULL)::INT + (y.label IS NOT NULL)::INT AS e, x.label = y.label AS ok FROM b LEFT JOIN g x ON id1 = x.id LEFT JOIN g y ON id2 = y.id), c AS (SELECT count(*) AS edges_total, count(*) FILTER (WHERE e = 2) AS lab, count(*) FILTER (WHERE e = 2 AND ok) AS tp, count(*) FILTER (WHERE e = 1) AS part_new, count(*) FILTER (WHERE e = 0) AS nov FROM s), nd AS (SELECT id1 AS id FROM b UNION SELECT id2 FROM b), nn AS (SELECT count(*) AS nodes, count(g.id) AS known FROM nd LEFT JOIN g USING (id)), w AS (SELECT *, CAST(tp AS DOUBLE) AS k, CAST(lab AS DOUBLE) AS n FROM c, nn), z AS (SELECT *, k / n AS p, {_W.format('-')} AS lo, {_W.format('+')} AS hi FROM w)"
    " SELECT edges_total, lab AS pred_pairs_labeled, tp AS tp_labeled, lab - tp AS fp_labeled, round(p, 6) AS prec_labeled, round(lo, 6) AS prec_low, round(hi, 6) AS prec_high, part_new AS semi_novel_edges, nov AS novel_edges, CAST(round((part_new + nov) * p) AS BIGINT) AS est_true_new_edges, CAST(round((part_new + nov) * lo) AS BIGINT) AS est_low, CAST(round((part_new + nov) * hi) AS BIGINT) AS est_high, nodes AS nodes_with_any_match, known AS nodes_with_any_match_labeled, nodes - known AS nodes_with_any_match_unlabeled FROM z"
)
def backend_analysis(spark, d):
    b = _backend(spark, d)
    return b.select(*(rounded(c, c) if c.startswith("prec") else c for c in b.columns))


def _backend(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "documents").select("doc_id")
    edges = ids.select(F.col("doc_id").alias("id1"), (F.col("doc_id") + 3).alias("id2")).join(ids.select(F.col("doc_id").alias("id2")), "id2", "left_semi")
    return evaluation.backend_analysis(edges, _known(spark, d))


@query("SELECT s_suppkey AS id, CASE WHEN s_nationkey = 3 THEN 'unknown' WHEN s_acctbal / 10000 >= 0.95 THEN 'excellent' WHEN s_acctbal / 10000 >= 0.9 THEN 'good' WHEN s_acctbal / 10000 >= 0.8 THEN 'ok' ELSE 'poor' END AS grade FROM supplier")
def grade_bands(spark, d):
    x = F.when(F.col("s_nationkey") != 3, F.col("s_acctbal") / 10000)
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), evaluation.grade(x).alias("grade"))


@query()
def auto_conclusions(spark, d):
    """Words for the row of ``backend_analysis``; tested case by case."""
    return evaluation.conclusions(_backend(spark, d))


@query(f"WITH {_RULED}, m AS (SELECT t AS model, 2.0 * sum(CASE WHEN score >= t AND label = 1 THEN 1 ELSE 0 END) / (sum(CASE WHEN score >= t THEN 1 ELSE 0 END) + sum(label)) AS f1 FROM sc, (SELECT unnest([0.3, 0.5, 0.7]) AS t) GROUP BY t) SELECT 'at ' || CAST(model AS VARCHAR) AS model, round(f1, 6) AS f1, row_number() OVER (ORDER BY round(f1, 12) DESC, model) AS place, row_number() OVER (ORDER BY round(f1, 12) DESC, model) = 1 AS best FROM m")
def model_comparison(spark, d):
    scored, out = staged(_ruled(spark, d), "scored"), None
    for t in (0.3, 0.5, 0.7):
        row = scoring.confusion(scored, t).select(F.lit(f"at {t}").alias("model"), "f1")
        out = row if out is None else out.union(row)
    return evaluation.compare_models(out).select("model", rounded("f1", "f1"), "place", "best")


@query(f"WITH {_RULED}, o AS (SELECT label, row_number() OVER (ORDER BY score DESC, id1 * 1000000 + id2) AS rk, sum(label) OVER () AS pos FROM sc) SELECT max(pos)::BIGINT AS k, round(sum(CASE WHEN rk <= pos THEN label ELSE 0 END) / CAST(max(pos) AS DOUBLE), 6) AS precision, round(sum(CASE WHEN rk <= pos THEN label ELSE 0 END) / CAST(max(pos) AS DOUBLE), 6) AS recall FROM o")
def precision_at_positives(spark, d):
    got = clusters.precision_at(staged(_ruled(spark, d).withColumn("id", F.expr("id1 * 1000000 + id2")), "scored"))
    return got.select(F.col("k").cast("long").alias("k"), rounded("precision", "precision"), rounded("recall", "recall"))


@query("SELECT CAST(ts AS DATE) AS day, count(*) AS n_records, count(DISTINCT user_id) AS n_users, round(100.0 * sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) / count(*), 2) AS rate FROM events GROUP BY 1")
def coverage(spark, d):
    hit = F.sum(F.when(F.col("event_type") == "purchase", 1).otherwise(0))
    return table(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n_records"), F.countDistinct("user_id").alias("n_users"), F.round(100.0 * hit / F.count("*"), 2).alias("rate"))


@query(f"WITH {PEOPLE_SQL}, w AS (SELECT heimild AS wave, count(*) AS n_records, count(person) AS n_labelled FROM people GROUP BY 1), u AS (SELECT * FROM w UNION ALL SELECT NULL, sum(n_records)::BIGINT, sum(n_labelled)::BIGINT FROM w) SELECT wave, n_records, n_labelled, round(100.0 * n_labelled / n_records, 2) AS rate FROM u")
def coverage_report(spark, d):
    p = people(spark, d)
    return profile.coverage(p, F.col("heimild"), F.col("person"))


def _families_sql() -> str:
    blank = " + ".join
    cols = ", ".join(f"sum({blank(f'({c} IS NULL)::INT' for c in cs)}) AS {f}" for f, cs in profile.FAMILIES.items())
    rows = " UNION ALL ".join(f"SELECT '{f}' AS family, wave, round(100.0 * {f} / (n * {len(cs)}), 2) AS rate FROM r" for f, cs in profile.FAMILIES.items())
    return f"WITH {PEOPLE_SQL}, r AS (SELECT heimild AS wave, count(*) AS n, {cols} FROM people GROUP BY ROLLUP (heimild)) {rows}"


@query(_families_sql())
def missing_families(spark, d):
    return profile.missing_by_family(people(spark, d), "heimild")


@query("WITH s AS (SELECT o_custkey, count(*) AS size FROM orders GROUP BY 1) SELECT count(*) AS n_clusters, CAST(floor(quantile_cont(size, 0.5)) AS BIGINT) AS median_size, CAST(floor(quantile_cont(size, 0.95)) AS BIGINT) AS p95_size, max(size) AS max_size, count(*) FILTER (WHERE size > 1) AS n_multiple FROM s")
def cluster_size_report(spark, d):
    return profile.size_report(table(spark, d, "orders"), "o_custkey")


@query("WITH s AS (SELECT count(*) AS size FROM orders GROUP BY o_custkey), c AS (SELECT size, count(*) AS n FROM s GROUP BY 1) SELECT size, n, round(sum(n) OVER (ORDER BY size DESC) / CAST(sum(n) OVER () AS DOUBLE), 6) AS share FROM c ORDER BY size LIMIT 50")
def size_ccdf(spark, d):
    return profile.size_ccdf(table(spark, d, "orders"), "o_custkey").select("size", "n", rounded("share", "share"))


@query("SELECT size, count(*) AS n FROM (SELECT o_custkey, count(*) AS size FROM orders GROUP BY 1) GROUP BY size")
def cluster_size_distribution(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("n"))


@query("SELECT lower(p_name) AS name, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, name LIMIT 100")
def top_names(spark, d):
    return profile.top_names(table(spark, d, "part"), F.col("p_name"))


@query("WITH n AS (SELECT lower(p_name) AS name, CAST(count(*) AS DOUBLE) AS n FROM part GROUP BY 1), t AS (SELECT sum(n) AS total FROM n), h AS (SELECT count(*) AS n_names, CAST(max(total) AS BIGINT) AS n_records, -sum(n / total * log2(n / total + 1e-10)) AS e FROM n, t), top AS (SELECT sum(n) AS top FROM (SELECT n FROM n ORDER BY n DESC, name LIMIT 10)) SELECT n_names, n_records, round(e, 6) AS entropy, round(pow(2, e), 4) AS effective_names, round(100.0 * top / n_records, 6) AS top_share FROM h, top")
def name_ambiguity(spark, d):
    return profile.name_ambiguity(table(spark, d, "part"), F.col("p_name")).select("n_names", "n_records", rounded("entropy", "entropy"), rounded("effective_names", "effective_names", 4), rounded("top_share", "top_share"))


@query("SELECT c_mktsegment, count(*) AS n, round(avg(c_acctbal), 6) AS mean, round(stddev_samp(c_acctbal), 6) AS std, min(c_acctbal) AS low, round(quantile_cont(c_acctbal, 0.25), 6) AS q1, round(quantile_cont(c_acctbal, 0.5), 6) AS median, round(quantile_cont(c_acctbal, 0.75), 6) AS q3, max(c_acctbal) AS high FROM customer GROUP BY 1")
def describe_numeric(spark, d):
    s = profile.describe_numeric(table(spark, d, "customer"), "c_acctbal", ["c_mktsegment"])
    return s.select("c_mktsegment", "n", rounded("mean", "mean"), rounded("std", "std"), "low", rounded("q1", "q1"), rounded("median", "median"), rounded("q3", "q3"), "high")


@query(f"WITH {PEOPLE_SQL}, x AS (SELECT (surname IS NULL)::INT AS a, (birthyear IS NULL)::INT AS b, (county IS NULL)::INT AS c FROM people) SELECT 'surname' AS a, 'birthyear' AS b, round(corr(a, b), 6) AS corr FROM x UNION ALL SELECT 'surname', 'county', round(corr(a, c), 6) FROM x UNION ALL SELECT 'birthyear', 'county', round(corr(b, c), 6) FROM x")
def null_correlation(spark, d):
    return profile.null_correlation(people(spark, d), ["surname", "birthyear", "county"]).select("a", "b", rounded("corr", "corr"))


@query("SELECT 'customer' AS name, count(*) AS n_rows, 5 AS n_columns, 'c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment' AS columns FROM customer UNION ALL SELECT 'supplier', count(*), 4, 's_suppkey, s_name, s_nationkey, s_acctbal' FROM supplier")
def synopsis(spark, d):
    return profile.synopsis({n: table(spark, d, n) for n in ("customer", "supplier")})


@query(f"WITH {PEOPLE_SQL} SELECT id, CASE WHEN person IS NULL THEN 'New' WHEN person = 5 THEN 'Anchor' ELSE 'Discrepant' END AS grp FROM people")
def anchor_groups(spark, d):
    return graph.node_groups(people(spark, d), "person", F.lit(5)).select("id", "grp")


@query()
def fitted_threshold_report(spark, d):
    """A threshold fitted on validation pairs and its confusion on test pairs, by grid; no single SQL."""
    split = staged(pairs.three_way(_ruled(spark, d)), "split")
    out = None
    for name in linkage.GRIDS:
        t = linkage.grid_threshold(split.where("split = 'val'"), name).first()[0]
        row = scoring.confusion(split.where("split = 'test'"), t).select(F.lit(name).alias("grid"), F.lit(t).alias("threshold"), rounded("f1", "f1"))
        out = row if out is None else out.union(row)
    return out
