"""Joins, sets and assertions, bound to documents, labels, orders, lineitem, events and part."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from decispark.operators import diffs, joins, preferences, sets, validation

from .registry import load, query
from .trial_queries import r


def _split(spark, sf_dir):
    d = load(spark, sf_dir, "documents")
    return d.where("doc_id % 5 <> 0"), d.where("doc_id % 5 = 0")


@query("j02_identity_join", """SELECT l.doc_id, CASE WHEN d.doc_id IS NULL THEN 'missing' WHEN (l.quality = 1) = (d.n_chars > 300) THEN 'matched' ELSE 'mismatch' END AS status FROM labels l LEFT JOIN documents d ON d.doc_id = l.doc_id AND d.doc_id % 7 <> 0""")
def j02(spark, sf_dir):
    labels = load(spark, sf_dir, "labels").withColumn("good", F.col("quality") == 1)
    docs = load(spark, sf_dir, "documents").where("doc_id % 7 <> 0").withColumn("long", F.col("n_chars") > 300)
    return joins.identity_join(labels, docs, ["doc_id"], {"good": "long"}).select("doc_id", "status")


@query("j03_overlap", "SELECT doc_id, doc_id IN (SELECT doc_id FROM labels) AS overlaps FROM documents")
def j03(spark, sf_dir):
    return joins.overlap(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"), ["doc_id"]).select("doc_id", "overlaps")


@query("j03_left_anti", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def j03a(spark, sf_dir):
    return load(spark, sf_dir, "documents").join(load(spark, sf_dir, "labels"), "doc_id", "left_anti").select("doc_id")


@query("j07_u02_leakage", """WITH a AS (SELECT * FROM documents WHERE doc_id % 5 <> 0), b AS (SELECT * FROM documents WHERE doc_id % 5 = 0)
SELECT 'text' AS key, count(*) AS shared FROM (SELECT sha256(text) FROM a INTERSECT SELECT sha256(text) FROM b) UNION ALL SELECT 'id', count(*) FROM (SELECT doc_id FROM a INTERSECT SELECT doc_id FROM b)""")
def j07(spark, sf_dir):
    train, test = _split(spark, sf_dir)
    return joins.leakage(train, test, {"text": F.sha2("text", 256), "id": F.col("doc_id").cast("string")})


@query("f05_quarantine", "SELECT doc_id FROM documents WHERE doc_id % 5 = 0 AND sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 5 <> 0)")
def f05(spark, sf_dir):
    train, test = _split(spark, sf_dir)
    key = F.sha2("text", 256)
    return test.withColumn("h", key).join(train.select(key.alias("h")), "h", "left_anti").select("doc_id")


INTERVALS = [(0.0, 10.0), (33.3, 47.0), (120.0, 180.5)]


@query("j06_range_join", "SELECT event_id, lo FROM events JOIN (VALUES (0.0, 10.0), (33.3, 47.0), (120.0, 180.5)) v(lo, hi) ON value BETWEEN lo AND hi")
def j06(spark, sf_dir):
    cells = spark.createDataFrame(INTERVALS, "lo double, hi double")
    return joins.in_intervals(load(spark, sf_dir, "events"), "value", cells, "lo", "hi", 25.0).select("event_id", "lo")


@query("j11_pair_lookup", """WITH p AS (SELECT l_orderkey, min(l_partkey) AS a, max(l_partkey) AS b, sum(l_quantity) AS q FROM lineitem GROUP BY 1 HAVING count(*) = 2)
SELECT x.l_orderkey, x.l_linenumber, q FROM lineitem x JOIN lineitem y ON x.l_orderkey = y.l_orderkey AND x.l_linenumber < y.l_linenumber JOIN p ON p.l_orderkey = x.l_orderkey AND least(x.l_partkey, y.l_partkey) = a AND greatest(x.l_partkey, y.l_partkey) = b""")
def j11(spark, sf_dir):
    li = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    p = li.groupBy("l_orderkey").agg(F.min("l_partkey").alias("a"), F.max("l_partkey").alias("b"), F.sum("l_quantity").alias("q"), F.count(F.lit(1)).alias("n")).where("n = 2").drop("n")
    two = li.join(p.select("l_orderkey"), "l_orderkey", "left_semi")
    y = two.select("l_orderkey", F.col("l_linenumber").alias("n2"), F.col("l_partkey").alias("y"))
    x = two.select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("x")).join(y, "l_orderkey").where("l_linenumber < n2")
    return joins.pair_lookup(x, "x", "y", p, "b", "a", ["l_orderkey"]).select("l_orderkey", "l_linenumber", "q").where("q is not null")


@query("j18_crosswalk", """WITH l AS (SELECT DISTINCT p_name AS name, lower(regexp_replace(p_name, '[^A-Za-z0-9]', '', 'g')) AS key FROM part), r AS (SELECT lower(regexp_replace(p_name, '[^A-Za-z0-9]', '', 'g')) AS key, count(DISTINCT p_brand) AS n, min(p_brand) AS value FROM part WHERE p_size < 45 GROUP BY 1)
SELECT name, l.key, CASE WHEN n = 1 THEN value END AS value, CASE WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'ambiguous' ELSE 'matched' END AS status FROM l LEFT JOIN r USING (key)""")
def j18(spark, sf_dir):
    p = load(spark, sf_dir, "part")
    return joins.crosswalk(p, F.col("p_name"), p.where("p_size < 45"), F.col("p_name"), "p_brand")


@query("j15_w10_w11_panel", """WITH p AS (SELECT row_number() OVER (ORDER BY e, s, a) - 1 AS index, * FROM (VALUES ('x'), ('y'), ('z')) v(e), (VALUES (1), (2)) w(s), (VALUES (0), (10), (20)) u(a)) SELECT index, e AS encounter, s AS stage, a AS level, 1000 + index AS seed, row_number() OVER (PARTITION BY e ORDER BY index) - 1 AS within FROM p""")
def j15(spark, sf_dir):

    d = joins.panel(spark, {"encounter": ["x", "y", "z"], "stage": [1, 2], "level": [0, 10, 20]}, 1000)
    return d.withColumn("within", F.row_number().over(W.partitionBy("encounter").orderBy("index")) - 1)


@query("j16_zipped", """WITH a AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS position FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT o_custkey, o_orderkey AS other, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS position FROM orders WHERE o_orderstatus = 'O')
SELECT o_custkey, position, o_orderkey, other, CASE WHEN o_orderkey IS NULL THEN 'right only' WHEN other IS NULL THEN 'left only' ELSE 'paired' END AS status FROM a FULL JOIN b USING (o_custkey, position)""")
def j16(spark, sf_dir):
    o = load(spark, sf_dir, "orders")
    left = o.where("o_orderstatus = 'F'").select("o_custkey", "o_orderkey")
    right = o.where("o_orderstatus = 'O'").select("o_custkey", F.col("o_orderkey").alias("other"))
    return joins.zipped(left, right, ["o_custkey"], ["o_orderkey"], ["other"])


@query("j17_v07_j19_key_differences", "SELECT o_custkey, 'left only' AS side FROM (SELECT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 0) UNION ALL SELECT c_custkey, 'right only' FROM (SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 0 EXCEPT SELECT o_custkey FROM orders)")
def j17(spark, sf_dir):
    c = load(spark, sf_dir, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("o_custkey"))
    return joins.key_differences(load(spark, sf_dir, "orders"), c, ["o_custkey"])


@query("j13_picked", "WITH w AS (SELECT range * 7 AS l_orderkey FROM range(1, 200)) SELECT l_orderkey, (SELECT count(*) FROM lineitem l WHERE l.l_orderkey = w.l_orderkey) AS n FROM w")
def j13(spark, sf_dir):
    return joins.picked(load(spark, sf_dir, "lineitem"), "l_orderkey", spark.range(1, 200).select((F.col("id") * 7).alias("l_orderkey")))


@query("j20_row_differences", "SELECT 'left only' AS side, o_orderstatus, o_custkey FROM (SELECT o_orderstatus, o_custkey FROM orders WHERE o_orderkey % 2 = 0 EXCEPT ALL SELECT o_orderstatus, o_custkey FROM orders WHERE o_orderkey % 2 = 1) UNION ALL SELECT 'right only', * FROM (SELECT o_orderstatus, o_custkey FROM orders WHERE o_orderkey % 2 = 1 EXCEPT ALL SELECT o_orderstatus, o_custkey FROM orders WHERE o_orderkey % 2 = 0)")
def j20(spark, sf_dir):
    o = load(spark, sf_dir, "orders")
    half = lambda k: o.where(F.col("o_orderkey") % 2 == k).select("o_orderstatus", "o_custkey")
    return joins.row_differences(half(0), half(1))


@query("v10_flat_diff", """WITH e AS (SELECT p_partkey, unnest(['p_brand', 'p_type', 'p_size']) AS path, unnest([p_brand, p_type, p_size::VARCHAR]) AS expected FROM part),
o AS (SELECT p_partkey, unnest(['p_brand', 'p_type', 'p_size']) AS path, unnest([p_brand, CASE WHEN p_partkey % 11 <> 0 THEN p_type END, (p_size + (p_partkey % 13 = 0)::INT)::VARCHAR]) AS observed FROM part WHERE p_partkey % 17 <> 0)
SELECT p_partkey, path, expected, observed FROM e FULL JOIN o USING (p_partkey, path) WHERE expected IS DISTINCT FROM observed""")
def v10(spark, sf_dir):
    p = load(spark, sf_dir, "part")
    o = p.where("p_partkey % 17 <> 0").withColumn("p_type", F.when(F.col("p_partkey") % 11 != 0, F.col("p_type"))).withColumn("p_size", F.col("p_size") + (F.col("p_partkey") % 13 == 0).cast("int"))
    return joins.structural_diff(p, o, ["p_partkey"], ["p_brand", "p_type", "p_size"])


@query("w03_u05_adjacent_difference", """WITH g AS (SELECT user_id, ts::DATE AS day, list(event_type) AS items FROM events GROUP BY ALL),
l AS (SELECT *, coalesce(lag(items) OVER (PARTITION BY user_id ORDER BY day), []) AS before FROM g),
t AS (SELECT user_id, day, v, len(list_filter(items, lambda x: x = v)) - len(list_filter(before, lambda x: x = v)) AS n FROM (SELECT *, unnest(list_distinct(items || before)) AS v FROM l))
SELECT user_id, day, coalesce(string_agg(rtrim(repeat(v || ',', n::INT), ','), ',' ORDER BY v) FILTER (WHERE n > 0), '') AS gained, coalesce(string_agg(rtrim(repeat(v || ',', -n::INT), ','), ',' ORDER BY v) FILTER (WHERE n < 0), '') AS lost FROM t GROUP BY ALL""")
def w03(spark, sf_dir):
    """Multisets of neighbouring rows; tests hold it against plain counters."""
    d = load(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.collect_list("event_type").alias("items"))
    return joins.adjacent_difference(d, "user_id", ["day"], "items").select("user_id", "day", "gained", "lost")


# sets


@query("u01_union", "SELECT doc_id FROM documents WHERE lang = 'en' UNION ALL SELECT doc_id FROM labels WHERE toxic = 1")
def u01(spark, sf_dir):
    return load(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id").unionByName(load(spark, sf_dir, "labels").where("toxic = 1").select("doc_id"))


@query("u03_difference", "SELECT l_partkey FROM (SELECT DISTINCT l_partkey FROM lineitem WHERE l_returnflag = 'R' EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity < 3)")
def u03(spark, sf_dir):
    li = load(spark, sf_dir, "lineitem")
    return li.where("l_returnflag = 'R'").select("l_partkey").subtract(li.where("l_quantity < 3").select("l_partkey"))


@query("u05_bag_difference", "WITH a AS (SELECT user_id, event_type, count(*) AS a FROM events WHERE event_id % 2 = 0 GROUP BY ALL), b AS (SELECT user_id, event_type, count(*) AS b FROM events WHERE event_id % 2 = 1 GROUP BY ALL) SELECT user_id, event_type, a - coalesce(b, 0) AS n FROM a LEFT JOIN b USING (user_id, event_type) WHERE a > coalesce(b, 0)")
def u05(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    return sets.bag_difference(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), ["user_id", "event_type"])


@query("u05_bag_intersection", "WITH a AS (SELECT user_id, event_type, count(*) AS a FROM events WHERE event_id % 2 = 0 GROUP BY ALL), b AS (SELECT user_id, event_type, count(*) AS b FROM events WHERE event_id % 2 = 1 GROUP BY ALL) SELECT user_id, event_type, least(a, b) AS n FROM a JOIN b USING (user_id, event_type)")
def u05i(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    return sets.bag_intersection(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), ["user_id", "event_type"])


@query("u04_u06_array_sets", """WITH s AS (SELECT l_orderkey, list_distinct(list(l_returnflag)) AS a, list_distinct(list(l_linestatus || l_returnflag)) AS b0, list_distinct(list(CASE WHEN l_quantity > 10 THEN l_returnflag END)) AS b FROM lineitem GROUP BY 1)
SELECT l_orderkey, list_aggregate(list_sort(list_filter(a, lambda x: NOT list_contains(b, x))), 'string_agg', ',') AS only_a, len(list_filter(b, lambda x: NOT list_contains(a, x))) = 0 AS subset FROM s""")
def u04(spark, sf_dir):
    d = load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("a"), F.collect_set(F.when(F.col("l_quantity") > 10, F.col("l_returnflag"))).alias("b"))
    text = F.array_join(sets.symmetric_difference(F.col("a"), F.col("b")), ",")
    return d.select("l_orderkey", F.when(text != "", text).alias("only_a"), sets.is_subset(F.col("b"), F.col("a")).alias("subset"))


@query("u08_union_of_tags", "SELECT o_custkey, string_agg(DISTINCT tag, ',' ORDER BY tag) AS tags FROM (SELECT o_custkey, unnest([o_orderstatus, o_orderpriority]) AS tag FROM orders) GROUP BY 1")
def u08(spark, sf_dir):
    return sets.union_of_tags(load(spark, sf_dir, "orders").select("o_custkey", F.array("o_orderstatus", "o_orderpriority").alias("tags")), "o_custkey", "tags")


# mixture


@query("a27_mixture_weights", """WITH d AS (SELECT doc_id, quality::VARCHAR AS src, lang FROM documents JOIN labels USING (doc_id)), n AS (SELECT src, count(*) AS n, count(DISTINCT lang) AS u FROM d GROUP BY 1), t AS (SELECT count(*) AS t FROM d)
SELECT doc_id, round(t * CASE WHEN src = '1' THEN 0.7 / (u * count(*) OVER (PARTITION BY src, lang)) ELSE 0.3 / n END, 6) AS loss_weight FROM d JOIN n USING (src), t""")
def a27(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select("doc_id", "lang").join(load(spark, sf_dir, "labels"), "doc_id").withColumn("src", F.col("quality").cast("string"))
    return preferences.mixture_weights(d, "src", {"1": 0.7, "0": 0.3}, "lang", "1").select("doc_id", r("loss_weight"))


@query("v06_mixture_masses", """WITH m AS (SELECT n_regionkey, CASE WHEN n_regionkey % 2 = 0 THEN 1.0 / count(*) OVER (PARTITION BY n_regionkey) ELSE (n_nationkey - 3) / 100.0 END AS mass FROM nation), g AS (SELECT n_regionkey, bool_and(mass > 0) AS fine, abs(sum(mass) - 1) <= 1e-12 AS one FROM m GROUP BY 1)
SELECT n_regionkey, rule FROM (SELECT n_regionkey, unnest(['positive', 'sum_one']) AS rule, unnest([fine, one]) AS ok FROM g) WHERE NOT ok""")
def v06(spark, sf_dir):
    mass = F.when(F.col("n_regionkey") % 2 == 0, F.lit(1.0) / F.count(F.lit(1)).over(W.partitionBy("n_regionkey"))).otherwise((F.col("n_nationkey") - 3) / 100.0)
    return validation.mixture_masses(load(spark, sf_dir, "nation").withColumn("mass", mass), "n_regionkey", "mass")


@query("v05_mass_shares", """WITH d AS (SELECT quality::VARCHAR AS src FROM labels) SELECT src, round(CASE WHEN src = '1' THEN 0.7 ELSE 0.3 END, 6) AS share FROM d GROUP BY 1""")
def v05m(spark, sf_dir):
    d = load(spark, sf_dir, "labels").withColumn("src", F.col("quality").cast("string"))
    return validation.mass_shares(preferences.mixture_weights(d, "src", {"1": 0.7, "0": 0.3}), "src", "loss_weight").select("src", r("share"))


# assertions


@query("v01_v20_duplicates", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def v01(spark, sf_dir):
    return validation.duplicates(load(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("v08_v19_broken_rules", """SELECT l_orderkey, l_linenumber, rule FROM (SELECT l_orderkey, l_linenumber, unnest(['small', 'discount', 'flag']) AS rule, unnest([l_quantity <= 45, l_discount < 0.1, l_returnflag <> 'R' OR l_linestatus = 'F']) AS ok FROM lineitem) WHERE NOT ok""")
def v08(spark, sf_dir):
    rules = {"small": F.col("l_quantity") <= 45, "discount": F.col("l_discount") < 0.1, "flag": (F.col("l_returnflag") != "R") | (F.col("l_linestatus") == "F")}
    return validation.broken(load(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], rules)


@query("v11_v14_v18_broken_counts", "SELECT count(*) FILTER (WHERE NOT (o_totalprice > 1000)) AS cheap, count(*) FILTER (WHERE NOT (o_orderstatus IN ('O', 'F'))) AS other FROM orders")
def v11(spark, sf_dir):
    return validation.broken_counts(load(spark, sf_dir, "orders"), {"cheap": F.col("o_totalprice") > 1000, "other": F.col("o_orderstatus").isin("O", "F")})


@query("v09_expected_observed", """SELECT doc_id, 'length' AS field, n_chars::VARCHAR AS expected, length(text)::VARCHAR AS observed FROM documents WHERE n_chars <> length(text) UNION ALL SELECT doc_id, 'lang', 'en', lang FROM documents WHERE lang <> 'en'""")
def v09(spark, sf_dir):
    d = load(spark, sf_dir, "documents").withColumn("seen", F.length("text").cast("long")).withColumn("en", F.lit("en"))
    return validation.expected_observed(d, ["doc_id"], {"length": ("n_chars", "seen"), "lang": ("en", "lang")})


@query("s18_v17_same_digest", "SELECT p_name, count(DISTINCT sha256(p_type)) AS digests FROM part GROUP BY 1 HAVING count(DISTINCT sha256(p_type)) > 1")
def s18(spark, sf_dir):
    return validation.same_digest(load(spark, sf_dir, "part").withColumn("h", F.sha2("p_type", 256)), "p_name", "h")


@query("a34_gates", "SELECT l_linestatus, count(*) AS compared, count(*) FILTER (WHERE l_tax < 0.08) AS matched, bool_and(l_tax < 0.08) AS all_match, coalesce(string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) FILTER (WHERE NOT l_tax < 0.08), '') AS missing FROM lineitem GROUP BY 1")
def a34(spark, sf_dir):
    return validation.gates(load(spark, sf_dir, "lineitem"), "l_linestatus", F.col("l_tax") < 0.08, "l_returnflag")


@query("v03_bound_hashes", "SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN sha256(left(text, 10)) ELSE sha256(text) END AS expected, sha256(text) AS observed FROM documents WHERE doc_id % 13 = 0 AND length(text) > 10")
def v03(spark, sf_dir):
    """Texts against the hashes bound to them; every thirteenth is that of the text's start."""
    d = load(spark, sf_dir, "documents").withColumn("bound", F.sha2(F.when(F.col("doc_id") % 13 == 0, F.substring("text", 1, 10)).otherwise(F.col("text")), 256)).withColumn("h", F.sha2("text", 256))
    return validation.expected_observed(d, ["doc_id"], {"text": ("bound", "h")}).select("doc_id", "expected", "observed")


@query("v04_edge_rules", """WITH e AS (SELECT l_orderkey, l_partkey, l_suppkey, l_quantity / sum(l_quantity) OVER (PARTITION BY l_orderkey) AS w FROM lineitem),
g AS (SELECT l_orderkey, bool_and(l_suppkey IN (SELECT l_partkey FROM e x WHERE x.l_orderkey = e.l_orderkey)) AS known, bool_and(l_partkey <> l_suppkey) AS distinct_sides, count(*) = count(DISTINCT (l_partkey, l_suppkey)) AS uniq, bool_and(w > 0) AS positive, abs(sum(w) - 1) < 1e-9 AS sum_one FROM e GROUP BY 1)
SELECT l_orderkey, rule FROM (SELECT l_orderkey, unnest(['known', 'distinct_sides', 'unique', 'positive', 'sum_one']) AS rule, unnest([known, distinct_sides, uniq, positive, sum_one]) AS ok FROM g) WHERE NOT ok""")
def v04(spark, sf_dir):
    """Rules over arrays of structs; tests hold each against plain loops."""
    w = F.col("l_quantity") / F.sum("l_quantity").over(W.partitionBy("l_orderkey"))
    d = load(spark, sf_dir, "lineitem").withColumn("w", w).groupBy("l_orderkey").agg(
        F.collect_list(F.struct(F.col("l_partkey").cast("string").alias("chosen"), F.col("l_suppkey").cast("string").alias("rejected"), F.col("w").alias("weight"))).alias("edges"),
        F.collect_set(F.col("l_partkey").cast("string")).alias("legal"),
    )
    return validation.broken(d, ["l_orderkey"], validation.edge_rules("edges", "legal"))


@query("j04_chained_lookups", """SELECT s_suppkey, r_name, CASE WHEN n_nationkey IS NULL THEN 'n_regionkey' WHEN r_regionkey IS NULL THEN 'r_name' END AS unmatched FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 6 <> 0) n ON s_nationkey = n_nationkey LEFT JOIN (SELECT * FROM region WHERE r_regionkey <> 2) r ON n_regionkey = r_regionkey""")
def j04(spark, sf_dir):
    nation = load(spark, sf_dir, "nation").where("n_nationkey % 6 <> 0")
    region = load(spark, sf_dir, "region").where("r_regionkey <> 2")
    d = joins.chained(load(spark, sf_dir, "supplier"), [(nation, "s_nationkey", "n_nationkey", "n_regionkey"), (region, "n_regionkey", "r_regionkey", "r_name")])
    return d.select("s_suppkey", "r_name", "unmatched")


@query("f06_loadable_routes", """WITH r AS (SELECT o_custkey, count(*) AS n, count(DISTINCT o_orderkey) AS d, bool_and(o_totalprice > 0) AS paid, bool_or(o_orderstatus = 'P') AS open FROM orders GROUP BY 1)
SELECT o_custkey, rule FROM (SELECT o_custkey, unnest(['unique', 'paid', 'closed', 'long']) AS rule, unnest([n = d, paid, NOT open, n >= 3]) AS ok FROM r) WHERE NOT ok""")
def f06(spark, sf_dir):
    r_ = load(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("o_orderkey").alias("d"), F.every(F.col("o_totalprice") > 0).alias("paid"), F.some(F.col("o_orderstatus") == "P").alias("open"))
    return validation.broken(r_, ["o_custkey"], {"unique": F.col("n") == F.col("d"), "paid": F.col("paid"), "closed": ~F.col("open"), "long": F.col("n") >= 3})


@query("v10_nested_differences", """WITH RECURSIVE e AS (
  SELECT o_orderkey AS k, json_object('status', o_orderstatus, 'lines', lines, 'meta', json_object('prio', o_orderpriority, 'who', json_object('cust', o_custkey))) AS j
  FROM orders JOIN (SELECT l_orderkey, list(json_object('part', l_partkey, 'qty', l_quantity::BIGINT) ORDER BY l_linenumber, l_partkey, l_quantity) AS lines FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey),
changed AS (SELECT l_orderkey, list(json_object('part', l_partkey, 'qty', l_quantity::BIGINT + (l_linenumber = 2 AND l_orderkey % 3 = 0)::INT) ORDER BY l_linenumber, l_partkey, l_quantity) AS lines FROM lineitem WHERE l_linenumber <> 4 OR l_orderkey % 2 = 0 GROUP BY 1),
a AS (
  SELECT o_orderkey AS k, CASE WHEN o_orderkey % 7 = 0 THEN json_object('lines', lines, 'meta', 'none') WHEN o_orderkey % 5 = 0 THEN json_object('status', o_orderstatus, 'lines', lines, 'meta', json_object('prio', o_orderpriority, 'who', json_object('cust', o_custkey + 1, 'new', json_object('x', 1))))
         ELSE json_object('status', o_orderstatus, 'lines', lines, 'meta', json_object('prio', o_orderpriority, 'who', json_object('cust', o_custkey))) END AS j
  FROM orders JOIN changed ON l_orderkey = o_orderkey WHERE o_orderkey % 13 <> 0),
w(k, path, e, a) AS (
  SELECT k, '$', e.j, a.j FROM e FULL JOIN a USING (k)
  UNION ALL
  SELECT k, x.p, x.e, x.a FROM (SELECT k, unnest(
    CASE WHEN json_type(e) = 'OBJECT' AND json_type(a) = 'OBJECT' THEN list_transform(list_distinct(json_keys(e) || json_keys(a)), lambda n: {'p': path || '.' || n, 'e': json_extract(e, '$.' || n), 'a': json_extract(a, '$.' || n)})
         WHEN json_type(e) = 'ARRAY' AND json_type(a) = 'ARRAY' THEN list_transform(range(0, least(json_array_length(e), json_array_length(a))::BIGINT), lambda n: {'p': path || '[' || n || ']', 'e': json_extract(e, '$[' || n || ']'), 'a': json_extract(a, '$[' || n || ']')}) END) AS x FROM w))
SELECT k, path, coalesce(CASE WHEN json_type(e) IN ('OBJECT', 'ARRAY') THEN 'container' ELSE e::VARCHAR END, '<absent>') AS expected, coalesce(CASE WHEN json_type(a) IN ('OBJECT', 'ARRAY') THEN 'container' ELSE a::VARCHAR END, '<absent>') AS observed FROM w
WHERE e::VARCHAR IS DISTINCT FROM a::VARCHAR AND NOT coalesce(json_type(e) = json_type(a) AND json_type(e) IN ('OBJECT', 'ARRAY'), false)
UNION ALL SELECT k, path || '.length', json_array_length(e)::VARCHAR, json_array_length(a)::VARCHAR FROM w WHERE json_type(e) = 'ARRAY' AND json_type(a) = 'ARRAY' AND json_array_length(e) <> json_array_length(a)""")
def v10n(spark, sf_dir):
    """Orders with their lines as nested documents, against changed ones: other values, lines, fields and kinds at several depths."""
    o, l = load(spark, sf_dir, "orders"), load(spark, sf_dir, "lineitem")  # noqa: E741
    k, qty = F.col("o_orderkey"), F.col("l_quantity").cast("bigint")

    def documents(lines, quantity, build):
        of = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", F.col("l_partkey").alias("part"), quantity.alias("qty")))), lambda x: F.struct(x["part"].alias("part"), x["qty"].alias("qty")))
        d = o.join(lines.groupBy("l_orderkey").agg(of.alias("lines")), F.col("l_orderkey") == k)
        return d.select(k.alias("k"), build.alias("j"))

    meta = F.struct(F.col("o_orderpriority").alias("prio"), F.struct(F.col("o_custkey").alias("cust")).alias("who")).alias("meta")
    other = F.struct(F.col("o_orderpriority").alias("prio"), F.struct((F.col("o_custkey") + 1).alias("cust"), F.struct(F.lit(1).alias("x")).alias("new")).alias("who")).alias("meta")
    status = F.col("o_orderstatus").alias("status")
    plain = F.to_json(F.struct(status, "lines", meta))
    changed = F.when(k % 7 == 0, F.to_json(F.struct("lines", F.lit("none").alias("meta")))).when(k % 5 == 0, F.to_json(F.struct(status, "lines", other))).otherwise(plain)
    more = ((F.col("l_linenumber") == 2) & (F.col("l_orderkey") % 3 == 0)).cast("int")
    observed = documents(l.where("l_linenumber <> 4 or l_orderkey % 2 = 0"), qty + more, changed).where("k % 13 <> 0")
    short = lambda c: F.when(F.col(c).startswith("{") | F.col(c).startswith("["), "container").otherwise(F.col(c)).alias(c)
    return diffs.nested_differences(documents(l, qty, plain), observed, ["k"], "j").select("k", "path", short("expected"), short("observed"))


@query("v15_first_divergence", """WITH a AS (SELECT conv_id, turn, role, text FROM conversations),
b AS (SELECT conv_id, CASE WHEN conv_id % 3 = 0 AND turn IN (1, 2) THEN 3 - turn ELSE turn END AS turn, role, text FROM conversations WHERE NOT (conv_id % 5 = 1 AND turn >= 2) UNION ALL SELECT conv_id, 99, 'user', 'x' FROM conversations WHERE conv_id % 7 = 2 AND turn = 0),
m AS (SELECT coalesce(a.conv_id, b.conv_id) AS conv_id, coalesce(a.turn, b.turn) AS turn, a.conv_id IS NOT NULL AS own,
  CASE WHEN b.conv_id IS NULL THEN 'not replayed' WHEN a.conv_id IS NULL THEN 'not recorded' WHEN (a.role, a.text) IS DISTINCT FROM (b.role, b.text) THEN 'diverges' END AS status FROM a FULL JOIN b ON a.conv_id = b.conv_id AND a.turn = b.turn),
f AS (SELECT conv_id, min(turn) FILTER (WHERE status IS NOT NULL) AS place FROM m GROUP BY 1)
SELECT conv_id, count(*) FILTER (WHERE own AND (place IS NULL OR turn < place)) AS verified, coalesce(max(status) FILTER (WHERE turn = place), 'verified') AS status, max(place) AS turn FROM m JOIN f USING (conv_id) GROUP BY 1""")
def v15(spark, sf_dir):
    """Conversations against a replay in which two turns change places, the end is missing, or a turn is new."""
    c = load(spark, sf_dir, "conversations")
    i, t = F.col("conv_id"), F.col("turn")
    replay = c.where(~((i % 5 == 1) & (t >= 2))).withColumn("turn", F.when((i % 3 == 0) & t.isin(1, 2), 3 - t).otherwise(t))
    extra = c.where((i % 7 == 2) & (t == 0)).select("conv_id", F.lit(99).cast("long").alias("turn"), F.lit("user").alias("role"), F.lit("x").alias("text"))
    return diffs.first_divergence(c, replay.unionByName(extra), "conv_id", "turn", ["role", "text"]).select("conv_id", "verified", "status", "turn")


@query("p05_bag_projection", """WITH l AS (SELECT l_orderkey, '{"part":' || l_partkey || ',"mode":"' || l_returnflag || '"}' AS j FROM lineitem)
SELECT l_orderkey, sha256('{"lines":[' || string_agg(j, ',' ORDER BY sha256('{"v":' || j || '}'), j) || '],"first":{"key":' || l_orderkey || '}}') AS digest, true AS permuted, false AS repeated FROM l GROUP BY 1""")
def p05(spark, sf_dir):
    """An order's lines as a bag: the digest of what is public, of the same lines in another order, and with one of them twice."""
    item = F.struct(F.col("l_partkey").alias("part"), F.col("l_returnflag").alias("mode"), F.col("l_linestatus").alias("private"))
    items = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", item.alias("item")))), lambda x: x["item"])
    d = load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(items.alias("lines"))
    spec = {"lines": diffs.Bag({"part": None, "mode": None}), "first": {"key": None}}
    state = lambda lines: F.struct(lines.alias("lines"), F.struct(F.col("l_orderkey").alias("key"), F.lit("p").alias("private")).alias("first"))
    d = d.select("l_orderkey", diffs.projection_digest(state(F.col("lines")), spec).alias("digest"), diffs.projection_digest(state(F.reverse("lines")), spec).alias("other"), diffs.projection_digest(state(F.concat("lines", F.slice("lines", 1, 1))), spec).alias("more"))
    return d.select("l_orderkey", "digest", (F.col("digest") == F.col("other")).alias("permuted"), (F.col("digest") == F.col("more")).alias("repeated"))
