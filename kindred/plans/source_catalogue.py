"""Queries of sources, sinks, selections, joins and samples of pairs, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from kindred.operators import judgments, linkage, pairs
from kindred.plans.linkage_catalogue import _ruled, _RULED
from kindred.plans.shared import PAIRS_SQL, PEOPLE_SQL, both_sql, people, people_pairs, query, rounded, table
from kindred.plans.stage import staged
from kindred.sources import sinks, tables

_RAW = "raw AS (SELECT c_custkey || '.0' AS person_key, c_mktsegment AS heimild, ' ' || upper(c_name) || '  ' AS nafn_norm, CASE WHEN c_nationkey = 3 THEN '' ELSE CAST(1800 + c_nationkey AS VARCHAR(9)) END AS birthyear, CASE WHEN c_nationkey % 2 = 0 THEN 'KARL' END AS sex FROM customer)"


@query(f"WITH {_RAW} SELECT CAST(CAST(person_key AS DOUBLE) AS BIGINT) AS id, CAST(NULL AS BIGINT) AS heimild, lower(trim(nafn_norm)) AS nafn_norm, CAST(nullif(birthyear, '') AS BIGINT) AS birthyear, lower(sex) AS sex FROM raw")
def people_scan_coerce(spark, d):
    raw = table(spark, d, "customer").selectExpr("c_custkey || '.0' AS person_key", "c_mktsegment AS heimild", "' ' || upper(c_name) || '  ' AS nafn_norm", "CASE WHEN c_nationkey = 3 THEN '' ELSE CAST(1800 + c_nationkey AS VARCHAR(9)) END AS birthyear", "CASE WHEN c_nationkey % 2 = 0 THEN 'KARL' END AS sex")
    return tables.people(raw, {"person_key": "id"}).select("id", "heimild", "nafn_norm", "birthyear", "sex")


@query(f"WITH {PEOPLE_SQL} SELECT CASE WHEN heimild < 1870 THEN 'train' WHEN heimild <= 1900 THEN 'val' ELSE 'test' END AS split, count(*) AS n_records, count(person) AS n_labelled, count(DISTINCT person) AS n_clusters FROM people GROUP BY 1")
def split_metadata(spark, d):
    return tables.split_counts(pairs.temporal_split(people(spark, d), F.col("heimild")))


@query(f"WITH {PEOPLE_SQL} SELECT id, person AS cluster FROM people WHERE person >= 0")
def truth_source(spark, d):
    return tables.truth_of(people(spark, d))


@query("SELECT s_suppkey AS id, concat_ws(' ', s_name, CAST(s_nationkey AS VARCHAR)) AS text, 'left' AS side FROM supplier UNION ALL SELECT c_custkey, concat_ws(' ', c_name, c_mktsegment), 'right' FROM customer")
def two_table_text(spark, d):
    left, right = tables.two_tables(table(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey"), table(spark, d, "customer").select(F.col("c_custkey").alias("id"), "c_name", "c_mktsegment"))
    return left.select("id", "text", F.lit("left").alias("side")).union(right.select("id", "text", F.lit("right")))


@query("SELECT CAST(l_partkey AS VARCHAR) AS ltable_id, CAST(l_suppkey AS VARCHAR) AS rtable_id, coalesce(try_cast(CASE WHEN l_returnflag = 'R' THEN '1' WHEN l_returnflag = 'N' THEN 'no' ELSE '0.0' END AS DOUBLE), 0)::INT AS label, count(*) AS n FROM lineitem GROUP BY ALL")
def pair_normaliser(spark, d):
    label = F.when(F.col("l_returnflag") == "R", "1").when(F.col("l_returnflag") == "N", "no").otherwise("0.0")
    raw = table(spark, d, "lineitem").select(F.col("l_partkey").alias("Left_ID"), F.col("l_suppkey").alias("id_b"), label.alias("is_match"))
    return tables.pair_table(raw).groupBy("ltable_id", "rtable_id", "label").agg(F.count("*").alias("n"))


@query(f"WITH {PEOPLE_SQL} SELECT id, concat_ws(' ', nafn_norm, first_name, patronym, surname, sex, status, marriagestatus, 'by:' || birthyear, 'parish:' || parish) AS text FROM people")
def people_text(spark, d):
    return tables.people_text(people(spark, d))


@query("SELECT c_custkey AS id, n_name AS parish_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def parish_names(spark, d):
    dim = table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("id"), F.concat(F.col("n_name"), F.lit(" ")).alias("name"))
    records = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("long").alias("parish"))
    return tables.named(records, "parish", dim, "parish_name").select("id", "parish_name")


@query("WITH e AS (SELECT l_partkey AS a, CASE WHEN l_linenumber = 1 THEN NULL ELSE l_suppkey END AS b, l_discount AS s FROM lineitem) SELECT least(a, b) AS id1, greatest(a, b) AS id2, max(s) AS score FROM e WHERE a <> b GROUP BY 1, 2")
def edge_scan(spark, d):
    raw = table(spark, d, "lineitem").select(F.col("l_partkey").cast("string").alias("from"), F.when(F.col("l_linenumber") == 1, "none").otherwise(F.col("l_suppkey").cast("string")).alias("to"), F.col("l_discount").cast("string").alias("s"))
    return tables.edge_table(raw, "from", "to", "s")


@query("SELECT o_custkey AS cluster_id, count(*) AS size, CAST(sum(o_orderkey) AS BIGINT) AS id_sum FROM orders GROUP BY 1")
def cluster_scan(spark, d):
    ids = F.sort_array(F.collect_list(F.col("o_orderkey").cast("string")))
    text = table(spark, d, "orders").groupBy(F.col("o_custkey").cast("string").alias("cluster_id")).agg(ids.alias("ids"))
    raw = text.select("cluster_id", F.when(F.col("cluster_id").cast("int") % 2 == 0, F.array_join("ids", ";")).otherwise(F.concat(F.lit("["), F.array_join("ids", ", "), F.lit("]"))).alias("members"))
    return tables.cluster_table(raw).select("cluster_id", "size", F.aggregate("members", F.lit(0).cast("long"), lambda a, x: a + x).alias("id_sum"))


_FIELDS = ["nafn_norm", "surname", "birthyear"]
_COL = " || ' ' || ".join("'COL {0} VAL ' || coalesce(CAST({0}{{0}} AS VARCHAR), '')".format(f) for f in _FIELDS)


@query(f"WITH {both_sql(_FIELDS)} SELECT id1, id2, label || chr(9) || {_COL.format(1)} || ' [SEP] ' || {_COL.format(2)} AS line FROM bp")
def ditto_lines(spark, d):
    return sinks.ditto_lines(people_pairs(spark, d), people(spark, d), "id", _FIELDS)


@query(f"WITH {both_sql(_FIELDS)} SELECT id1, id2, label, {', '.join(f'{f}1 AS left_{f}' for f in _FIELDS)}, {', '.join(f'{f}2 AS right_{f}' for f in _FIELDS)} FROM bp")
def anymatch_rows(spark, d):
    return sinks.anymatch_rows(people_pairs(spark, d), people(spark, d), "id", _FIELDS)


@query(f"WITH {PAIRS_SQL} SELECT '{{\"source\":' || id1 || ',\"target\":' || id2 || ',\"label\":' || label || '}}' AS json FROM pr")
def graph_edges_json(spark, d):
    return sinks.graph_json(people_pairs(spark, d), people(spark, d), "id", _FIELDS)[1]


@query(f"WITH {PAIRS_SQL} SELECT CAST(id1 AS VARCHAR) AS ltable_id, CAST(id2 AS VARCHAR) AS rtable_id, a.nafn_norm || ' ||| ' || b.nafn_norm || ' ||| ' || label AS line FROM pr JOIN people a ON a.id = id1 JOIN people b ON b.id = id2")
def triple_lines(spark, d):
    texts = people(spark, d).select(F.col("id").cast("string").alias("id"), F.col("nafn_norm").alias("text"))
    named = people_pairs(spark, d).select(F.col("id1").cast("string").alias("ltable_id"), F.col("id2").cast("string").alias("rtable_id"), "label")
    return sinks.triple_lines(pairs.pair_texts(named, texts, texts))


_TERM = "coalesce(nullif(left(trim(regexp_replace(lower(trim({0})), '[^a-z0-9]+', '_', 'g'), '_'), 30), ''), 'unknown')"


@query(f"WITH {PEOPLE_SQL}, s AS (SELECT id, unnest([CASE WHEN nafn_norm IS NOT NULL THEN 'nafn_norm_' || {_TERM.format('nafn_norm')} END, CASE WHEN surname IS NOT NULL THEN 'surname_' || {_TERM.format('surname')} END, CASE WHEN birthyear IS NOT NULL THEN 'birthyear_' || birthyear END]) AS t FROM people) SELECT id, '<{{' || id || '}} --> [' || t || ']>. :|:' AS statement FROM s WHERE t IS NOT NULL")
def narsese_records(spark, d):
    return sinks.narsese_records(people(spark, d), "id", _FIELDS)


@query("SELECT 'graph G { rankdir=\"LR\"; node [shape=box];' || chr(10) || (SELECT string_agg('  \"' || n_nationkey || '\" [label=\"' || n_name || '\"];', chr(10) ORDER BY n_nationkey) FROM nation) || chr(10) || (SELECT string_agg('  \"' || n_nationkey || '\" -- \"' || 100 + n_regionkey || '\";', chr(10) ORDER BY n_nationkey) FROM nation) || chr(10) || '}' AS dot")
def dot_export(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id1"), (F.col("n_regionkey") + 100).cast("long").alias("id2"), "n_name")
    return sinks.dot_text(n.select("id1", "id2"), n.select(F.col("id1").alias("id"), F.col("n_name").alias("label")))


@query("SELECT 'left' AS _table, c_custkey AS id, c_name AS name, c_mktsegment AS segment FROM customer UNION ALL SELECT 'right', s_suppkey, s_name, NULL FROM supplier")
def union_provenance(spark, d):
    left = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    right = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return pairs.union_tables(left, right)


@query("WITH ids AS (SELECT DISTINCT p_partkey AS id FROM part WHERE p_size < 5), l AS (SELECT s_suppkey AS id, s_name AS name FROM supplier), r AS (SELECT c_custkey AS id, c_name AS name FROM customer) SELECT 'left' AS _table, id, name FROM l WHERE id IN (SELECT id FROM ids) UNION ALL SELECT 'right', id, name FROM r WHERE id IN (SELECT id FROM ids) AND id NOT IN (SELECT id FROM l)")
def record_lookup(spark, d):
    left = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    right = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return pairs.lookup(left, right, table(spark, d, "part").where("p_size < 5").select(F.col("p_partkey").alias("id")))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '2-HIGH')")
def id_semi_filter(spark, d):
    ids = table(spark, d, "orders").where("o_orderpriority = '2-HIGH'").select(F.col("o_custkey").alias("id"))
    return pairs.only(table(spark, d, "customer").select("c_custkey", "c_name"), ids, "c_custkey")


@query(f"WITH {_RULED} SELECT id1, id2 FROM sc WHERE score >= 0.5")
def positives_filter(spark, d):
    return pairs.positives(_ruled(spark, d)).select("id1", "id2")


@query(f"WITH {PAIRS_SQL}, tr AS (SELECT a.id AS id1, b.id AS id2 FROM people a JOIN people b ON a.person = b.person AND a.id < b.id) SELECT id1, id2 FROM pr INTERSECT SELECT id1, id2 FROM tr")
def candidate_truth(spark, d):
    return pairs.captured(people_pairs(spark, d), pairs.truth_pairs(people(spark, d).select("id", F.col("person").alias("cluster"))))


@query(f"WITH {PEOPLE_SQL} SELECT * EXCLUDE (person) FROM people")
def label_free(spark, d):
    return judgments.hide_labels(people(spark, d))


@query("SELECT c_custkey AS id, CASE WHEN row_number() OVER (ORDER BY c_custkey) <= (SELECT count(*) // 2 FROM customer) THEN 'left' ELSE 'right' END AS side FROM customer")
def table_halves(spark, d):
    return pairs.halves(table(spark, d, "customer").select(F.col("c_custkey").alias("id")))


@query("SELECT s_suppkey AS key, s_name FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 100")
def renamed_head(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal", "s_nationkey")
    return pairs.top_rows(s, [F.col("s_acctbal").desc(), F.col("s_suppkey")], 100, {"s_suppkey": "key"}, ("s_acctbal", "s_nationkey"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE contains(CAST(l_partkey AS VARCHAR), '77') OR contains(CAST(l_suppkey AS VARCHAR), '77') OR contains(lower(l_returnflag), '77') OR contains(lower(l_linestatus), '77')")
def edge_search(spark, d):
    return pairs.search(table(spark, d, "lineitem"), ["l_partkey", "l_suppkey", "l_returnflag", "l_linestatus"], "77").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("SELECT o_orderkey FROM orders WHERE (o_orderkey * 2654435761 + 42) % 2147483648 < 0.1 * 2147483648")
def share_sample(spark, d):
    return pairs.sample_share(table(spark, d, "orders").select("o_orderkey"), F.col("o_orderkey"), 0.1)


_H = "(id1 * 40503 + id2 * 2654435761 + {0}) % 2147483648"


@query(f"WITH {PAIRS_SQL} SELECT id1, id2, label FROM pr ORDER BY {_H.format(42)}, id1, id2 LIMIT 1000")
def capped_sample(spark, d):
    return pairs.cap_pairs(people_pairs(spark, d), 1000).select("id1", "id2", "label")


@query("WITH n AS (SELECT max(p_partkey) AS m FROM part), p AS (SELECT p_partkey AS id1, p_partkey + 100 AS id2 FROM part) SELECT id1, id2, a.p_name AS p_name1, b.p_name AS p_name2 FROM p LEFT JOIN part a ON id1 = a.p_partkey LEFT JOIN part b ON id2 = b.p_partkey")
def pair_records(spark, d):
    part = table(spark, d, "part")
    some = part.select(F.col("p_partkey").alias("id1"), (F.col("p_partkey") + 100).alias("id2"))
    return pairs.attach(some, part, "p_partkey", ["p_name"])


@query("SELECT CAST(l_partkey AS BIGINT) AS ltable_id, l_suppkey AS rtable_id, coalesce(p_name, '') || ' [SEP] ' || coalesce(s_name, '') AS pair_text FROM (SELECT DISTINCT l_partkey + 50 AS l_partkey, l_suppkey FROM lineitem) LEFT JOIN part ON p_partkey = l_partkey LEFT JOIN supplier ON s_suppkey = l_suppkey")
def pair_texts(spark, d):
    some = table(spark, d, "lineitem").select((F.col("l_partkey") + 50).alias("ltable_id"), F.col("l_suppkey").alias("rtable_id")).distinct()
    left = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text"))
    right = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("text"))
    return pairs.pair_texts(some, left, right).select("ltable_id", "rtable_id", "pair_text")


@query(f"WITH {_RULED}, tr AS (SELECT * FROM sc WHERE id1 % 3 = 0), c AS (SELECT id1, id2 FROM sc WHERE id2 % 2 = 0) SELECT id1, id2, label FROM c JOIN tr USING (id1, id2)")
def known_candidates(spark, d):
    scored = staged(_ruled(spark, d), "scored")
    return pairs.known_pairs(scored.where("id2 % 2 = 0").select("id1", "id2"), scored.where("id1 % 3 = 0")).select("id1", "id2", "label")


_GT = "gt AS (SELECT c_custkey AS id, lpad(CAST(c_nationkey AS VARCHAR), 2, '0') AS head, c_acctbal AS x, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_custkey % 300 END AS cluster, (c_custkey * 2654435761 + 42) % 2147483648 AS h FROM customer)"


@query(
    f"WITH {_GT}, pos AS (SELECT a.id AS id1, b.id AS id2 FROM gt a JOIN gt b ON a.cluster = b.cluster AND a.id < b.id ORDER BY (a.id * 40503 + b.id * 2654435761 + 42) % 2147483648, a.id, b.id LIMIT 500),"
    f" near AS (SELECT a.id AS id1, b.id AS other FROM gt a JOIN gt b ON a.head = b.head AND a.id <> b.id AND a.cluster IS DISTINCT FROM b.cluster AND abs(a.x - b.x) <= 300),"
    f" best AS (SELECT id1, arg_min(other, [{_H.format(42).replace('id2', 'other')}, other]) AS other FROM near GROUP BY 1),"
    f" pl AS (SELECT id, cluster, row_number() OVER (ORDER BY h, id) - 1 AS r, count(*) OVER () AS n FROM gt),"
    f" spare AS (SELECT a.id AS id1, arg_min(b.id, k) AS other FROM pl a, (SELECT unnest([1, 2, 3]) AS k), pl b WHERE b.r = (a.r + k) % a.n AND a.cluster IS DISTINCT FROM b.cluster GROUP BY 1),"
    f" neg AS (SELECT id1, coalesce(best.other, spare.other) AS other FROM pos LEFT JOIN best USING (id1) LEFT JOIN spare USING (id1))"
    f" SELECT id1, id2, 1 AS label FROM pos UNION ALL SELECT least(id1, other), greatest(id1, other), 0 FROM neg WHERE other IS NOT NULL"
)
def training_pairs(spark, d):
    gt = table(spark, d, "customer").selectExpr("c_custkey AS id", "lpad(CAST(c_nationkey AS STRING), 2, '0') AS text", "c_acctbal AS number", "CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_custkey % 300 END AS cluster")
    return pairs.training_pairs(gt, 500, 300)


@query(
    f"WITH {_GT}, many AS (SELECT cluster FROM gt WHERE cluster IS NOT NULL GROUP BY 1 HAVING count(*) > 1), chosen AS (SELECT cluster FROM many ORDER BY (cluster * 2654435761 + 42) % 2147483648, cluster LIMIT 100),"
    " m AS (SELECT id, cluster, row_number() OVER (ORDER BY id) - 1 AS r, count(*) OVER () AS n FROM gt WHERE cluster IN (SELECT cluster FROM chosen)),"
    " pos AS (SELECT a.id AS id1, b.id AS id2 FROM m a JOIN m b ON a.cluster = b.cluster AND a.id < b.id), k AS (SELECT greatest(0, least(2 * count(*), 5000 - count(*))) AS want FROM pos),"
    " t AS (SELECT unnest(range(1, (SELECT (want * 2 + (SELECT max(n) FROM m) - 1) // (SELECT max(n) FROM m) + 2 FROM k))) AS t),"
    " neg AS (SELECT DISTINCT least(a.id, b.id) AS id1, greatest(a.id, b.id) AS id2 FROM m a, t, m b WHERE b.r = (a.r + 1 + (t * 7919 + 42) % (a.n - 1)) % a.n AND a.cluster <> b.cluster)"
    f" SELECT id1, id2, 1 AS label FROM pos UNION ALL (SELECT id1, id2, 0 FROM neg ORDER BY {_H.format(42)}, id1, id2 LIMIT (SELECT want FROM k))"
)
def person_pairs(spark, d):
    gt = table(spark, d, "customer").selectExpr("c_custkey AS id", "CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_custkey % 300 END AS cluster")
    return pairs.person_pairs(gt, 100, 5000)


@query(f"WITH {PAIRS_SQL}, o AS (SELECT id1, id2, label, row_number() OVER (ORDER BY {_H.format(42)}, id1, id2) - 1 AS r, count(*) OVER () AS n FROM pr) SELECT id1, id2, CASE WHEN r < CAST(floor(0.7 * n) AS BIGINT) THEN 'train' WHEN r < CAST(floor(0.85 * n) AS BIGINT) THEN 'val' ELSE 'test' END AS split FROM o")
def pair_split_701515(spark, d):
    return pairs.three_way(people_pairs(spark, d)).select("id1", "id2", "split")


@query(f"WITH {PAIRS_SQL}, o AS (SELECT id1, id2, row_number() OVER (ORDER BY id1, id2) - 1 AS r, count(*) OVER () AS n FROM pr) SELECT id1, id2, CASE WHEN r < CAST(floor(0.7 * n) AS BIGINT) THEN 'train' ELSE 'test' END AS split FROM o")
def head_tail_split(spark, d):
    return pairs.head_tail(people_pairs(spark, d)).select("id1", "id2", "split")


@query(f"WITH {PAIRS_SQL}, o AS (SELECT label, row_number() OVER (ORDER BY {_H.format(42)}, id1, id2) - 1 AS r, count(*) OVER () AS n FROM pr) SELECT count(*) FILTER (WHERE r < floor(0.7 * n)) AS n_train, count(*) FILTER (WHERE r >= floor(0.7 * n) AND r < floor(0.85 * n)) AS n_val, count(*) FILTER (WHERE r >= floor(0.85 * n)) AS n_test, round(avg(label) FILTER (WHERE r < floor(0.7 * n)), 6) AS train_pos_ratio, (SELECT count(*) FROM part) AS n_left, (SELECT count(*) FROM supplier) AS n_right FROM o")
def dataset_statistics(spark, d):
    s = pairs.statistics(pairs.three_way(people_pairs(spark, d)), table(spark, d, "part"), table(spark, d, "supplier"))
    return s.withColumn("train_pos_ratio", F.round("train_pos_ratio", 6))


@query(f"WITH {PAIRS_SQL}, s AS (SELECT id1, id2, label FROM pr ORDER BY {_H.format(42)}, id1, id2 LIMIT 500) SELECT id1 AS left_id, id2 AS right_id, a.nafn_norm AS left_text, b.nafn_norm AS right_text, label FROM s JOIN people a ON a.id = id1 JOIN people b ON b.id = id2")
def text_pair_table(spark, d):
    some = pairs.cap_pairs(people_pairs(spark, d), 500).select(F.col("id1").alias("ltable_id"), F.col("id2").alias("rtable_id"), "label")
    texts = people(spark, d).select("id", F.col("nafn_norm").alias("text"))
    return pairs.pair_texts(some, texts, texts).select(F.col("ltable_id").alias("left_id"), F.col("rtable_id").alias("right_id"), "left_text", "right_text", "label")


_SAME = lambda f: f"CASE WHEN {f}1 IS NULL OR {f}2 IS NULL THEN 0.5 WHEN {f}1 = {f}2 THEN 1.0 ELSE 0.0 END"
_RULES = ["nafn_norm", "first_name", "patronym", "surname", "birthyear", "sex", "parish", "county"]


@query(f"WITH {both_sql(_RULES)} SELECT id1, id2, round((3 * {_SAME('nafn_norm')} + 2 * {_SAME('first_name')} + 1.5 * {_SAME('patronym')} + 1.5 * {_SAME('surname')} + 2 * CASE WHEN birthyear1 IS NULL OR birthyear2 IS NULL THEN 0.5 WHEN abs(birthyear1 - birthyear2) <= 5 THEN 1 - abs(birthyear1 - birthyear2) / 6.0 ELSE 0 END + {_SAME('sex')} + 0.5 * {_SAME('parish')} + 0.5 * {_SAME('county')}) / 12.0, 6) AS score FROM bp")
def default_rules_scores(spark, d):
    both = pairs.attach(people_pairs(spark, d), people(spark, d), "id", _RULES)
    return both.select("id1", "id2", rounded(linkage.rules_score(), "score"))
