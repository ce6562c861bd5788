"""Rates, choices and scores, bound to part, supplier, orders and lineitem."""

from __future__ import annotations

from pyspark.sql import functions as F

from decispark.functions import scalar
from decispark.operators import rewards

from .registry import load, query
from .trial_queries import r

PARTS = """WITH rates AS (SELECT p_partkey, p_brand, p_type, p_size, CASE WHEN p_size % 10 = 0 THEN NULL ELSE p_size / 50.0 END AS first_pick_rate_f1, CASE WHEN p_size % 7 = 0 THEN 0.0 ELSE (p_partkey % 50) / 49.0 END AS first_pick_rate_f2, p_size AS sample_size FROM part),
long AS (SELECT p_partkey, 'first_pick_rate_f1' AS metric, first_pick_rate_f1 AS rate, sample_size FROM rates UNION ALL SELECT p_partkey, 'first_pick_rate_f2', first_pick_rate_f2, sample_size FROM rates)
"""
METRICS = ["first_pick_rate_f1", "first_pick_rate_f2"]


def _rates(spark, sf_dir):
    p = load(spark, sf_dir, "part")
    return p.select(
        "p_partkey", "p_brand", "p_type", "p_size", F.when(F.col("p_size") % 10 != 0, F.col("p_size") / 50.0).alias("first_pick_rate_f1"),
        F.when(F.col("p_size") % 7 == 0, F.lit(0.0)).otherwise((F.col("p_partkey") % 50) / 49.0).alias("first_pick_rate_f2"), F.col("p_size").alias("sample_size"),
    )


def _long(spark, sf_dir):
    return rewards.unpivot_rates(_rates(spark, sf_dir).select("p_partkey", "sample_size", *METRICS), ["p_partkey", "sample_size"], METRICS)


@query("s06_unpivot_lookup", PARTS + "SELECT p_partkey, metric, round(rate, 6) AS rate FROM long WHERE rate IS NOT NULL AND metric = 'first_pick_rate_f2'")
def s06(spark, sf_dir):
    return _long(spark, sf_dir).where("rate is not null and metric = 'first_pick_rate_f2'").select("p_partkey", "metric", r("rate"))


@query("a21_rate_quality", PARTS + "SELECT metric, count(*) AS rows, count(*) FILTER (WHERE rate IS NULL) AS nulls, count(*) FILTER (WHERE rate = 0) AS zeros, count(*) FILTER (WHERE rate = 1) AS ones, min(sample_size) AS least_size, max(sample_size) AS most_size FROM long GROUP BY metric")
def a21(spark, sf_dir):
    return rewards.rate_quality(_long(spark, sf_dir), "sample_size")


@query("v13_j05_coverage_gaps", "SELECT p_type, size FROM (SELECT DISTINCT p_type FROM part), (SELECT range::INT AS size FROM range(1, 51)) EXCEPT SELECT p_type, p_size::INT FROM part")
def v13(spark, sf_dir):
    p = load(spark, sf_dir, "part")
    scope = p.select("p_type").distinct().withColumn("size", F.explode(F.sequence(F.lit(1), F.lit(50))))
    return rewards.coverage_gaps(scope, p.select("p_type", F.col("p_size").cast("int").alias("size")), ["p_type", "size"])


@query("j08_j09_offered_rates", PARTS + """, o AS (SELECT l_orderkey, l_linenumber, l_partkey AS p_partkey, CASE WHEN l_quantity > 25 THEN 'first_pick_rate_f1' ELSE 'first_pick_rate_f2' END AS metric FROM lineitem)
SELECT l_orderkey, l_linenumber, p_partkey, round(CASE WHEN rate IS NOT NULL AND sample_size >= 5 THEN rate ELSE 0.05 END, 6) AS target_rate, CASE WHEN rate IS NOT NULL AND sample_size >= 5 THEN 'database' ELSE 'fallback_probability' END || ':' || metric AS rate_source
FROM o LEFT JOIN long USING (p_partkey, metric)""")
def j08(spark, sf_dir):
    o = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("p_partkey"), "l_quantity")
    metric = F.when(F.col("l_quantity") > 25, METRICS[0]).otherwise(METRICS[1])
    d = rewards.offered_rates(o, _long(spark, sf_dir), ["p_partkey"], metric, 5, 0.05)
    return d.select("l_orderkey", "l_linenumber", "p_partkey", r("target_rate"), "rate_source")


@query("a26_choice_distribution", """WITH o AS (SELECT p_brand, p_type AS choice, max(p_size) / 50.0 AS rate FROM part GROUP BY p_brand, p_type),
s AS (SELECT p_brand, sum(rate) AS total FROM o GROUP BY 1)
SELECT p_brand, choice, round(CASE WHEN total <= 0.98 THEN rate ELSE 0.98 * rate / total END, 9) AS probability FROM o JOIN s USING (p_brand)
UNION ALL SELECT p_brand, 'SKIP', round(CASE WHEN total <= 0.98 THEN 1 - total ELSE 0.02 END, 9) FROM s""")
def a26(spark, sf_dir):
    o = load(spark, sf_dir, "part").groupBy("p_brand", F.col("p_type").alias("choice")).agg((F.max("p_size") / 50.0).alias("rate"))
    return rewards.choice_distribution(o, "p_brand", "choice", "rate", 0.02).select("p_brand", "choice", r("probability", 9))


@query("w07_r07_inverse_cdf", """WITH c AS (SELECT p_type, p_partkey, sum(p_size) OVER (PARTITION BY p_type ORDER BY p_partkey ROWS UNBOUNDED PRECEDING) / sum(p_size) OVER (PARTITION BY p_type) AS cum,
('0x' || substr(sha256('5|' || p_type), 1, 16))::UBIGINT::DOUBLE / pow(2.0, 64) AS u FROM part)
SELECT p_type, p_partkey FROM c QUALIFY row_number() OVER (PARTITION BY p_type ORDER BY (cum > u) DESC, CASE WHEN cum > u THEN p_partkey ELSE -p_partkey END) = 1""")
def w07(spark, sf_dir):
    p = load(spark, sf_dir, "part")
    return rewards.inverse_cdf(p, "p_type", ["p_partkey"], "p_size", F.concat(F.lit("5|"), F.col("p_type"))).select("p_type", "p_partkey")


@query("w05_top_fraction", "SELECT s_suppkey, round(row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) / count(*) OVER (PARTITION BY s_nationkey), 6) AS top_fraction FROM supplier")
def w05(spark, sf_dir):
    return rewards.top_fraction(load(spark, sf_dir, "supplier"), ["s_nationkey"], "s_acctbal", "s_suppkey").select("s_suppkey", r("top_fraction"))


@query("w06_normalized_rank", "SELECT s_suppkey, round((row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey) - 1) / greatest(1, count(*) OVER (PARTITION BY s_nationkey) - 1), 6) AS rank FROM supplier")
def w06(spark, sf_dir):
    return rewards.normalized_rank(load(spark, sf_dir, "supplier"), ["s_nationkey"], ["s_acctbal", "s_suppkey"]).select("s_suppkey", r("rank"))


@query("a30_search_components", """WITH e AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS pair, value FROM events),
x AS (SELECT a.user_id, a.event_type, count(*) FILTER (WHERE a.value > b.value) AS pair_wins, count(*) AS pairs, avg(a.value) AS m FROM e a JOIN e b ON a.user_id = b.user_id AND a.pair = b.pair AND b.event_type = 'view' GROUP BY ALL),
k AS (SELECT *, (row_number() OVER (PARTITION BY user_id ORDER BY m, event_type) - 1) / greatest(1, count(*) OVER (PARTITION BY user_id) - 1) AS rank FROM x)
SELECT user_id, event_type, pair_wins, pairs, round(0.6 * pair_wins / pairs + 0.4 * rank, 6) AS search_score FROM k""")
def a30(spark, sf_dir):
    from pyspark.sql import Window as W

    e = load(spark, sf_dir, "events").withColumn("pair", F.row_number().over(W.partitionBy("user_id", "event_type").orderBy("ts", "event_id")))
    return rewards.search_components(e, "user_id", "event_type", "pair", "view", ["value"]).select("user_id", "event_type", "pair_wins", "pairs", r("search_score"))


TOKENS = "list_distinct(string_split(p_type, ' '))"


@query("j10_set_overlap", """WITH c AS (SELECT DISTINCT p_brand, unnest(string_split(p_type, ' ')) AS tag FROM part WHERE p_size > 40), p AS (SELECT DISTINCT p_partkey, unnest(string_split(p_name, ' ')) AS tag FROM part UNION SELECT DISTINCT p_partkey, unnest(string_split(p_type, ' ')) FROM part)
SELECT p_brand, count(*) AS matches FROM (SELECT DISTINCT p_brand, p_partkey FROM c JOIN p USING (tag)) GROUP BY 1""")
def j10(spark, sf_dir):
    p = load(spark, sf_dir, "part")
    brands = p.where("p_size > 40").select("p_brand", F.split("p_type", " ").alias("tags"))
    pool = p.select("p_partkey", F.concat(F.split("p_name", " "), F.split("p_type", " ")).alias("tags"))
    return rewards.tag_matches(brands, pool, "p_brand", "tags", "p_partkey", "tags")


@query("a31_provider_counts", """WITH t AS (SELECT l_orderkey, unnest([l_returnflag, 'status_' || l_linestatus]) AS tag FROM lineitem), n AS (SELECT l_orderkey, tag, count(*) AS n FROM t GROUP BY ALL),
x AS (SELECT l_orderkey, 'density' AS tag, 1 AS n FROM n WHERE tag = 'N' AND n >= 3 UNION ALL SELECT l_orderkey, 'light', 1 FROM n GROUP BY 1 HAVING coalesce(max(n) FILTER (WHERE tag = 'A'), 0) = 0)
SELECT l_orderkey, tag, sum(n)::BIGINT AS n FROM (SELECT * FROM n UNION ALL SELECT * FROM x) GROUP BY ALL""")
def a31(spark, sf_dir):
    d = load(spark, sf_dir, "lineitem").select("l_orderkey", F.array(F.col("l_returnflag"), F.concat(F.lit("status_"), F.col("l_linestatus"))).alias("tags"))
    n = lambda k: F.coalesce(F.try_element_at("n", F.lit(k)), F.lit(0))
    return rewards.provider_counts(d, "l_orderkey", "tags", {"density": n("N") >= 3, "light": n("A") == 0})


@query("k07_protected_choice", """WITH o AS (SELECT *, CASE WHEN o_orderpriority LIKE '1%' THEN 20000.0 WHEN o_orderpriority LIKE '2%' THEN 8000.0 END AS margin FROM orders),
t AS (SELECT o_custkey, o_orderkey AS top, o_totalprice AS tu FROM o QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1),
s AS (SELECT o_custkey, o_orderkey AS safe, o_totalprice AS su, margin FROM o WHERE margin IS NOT NULL QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1)
SELECT o_custkey, CASE WHEN coalesce(tu - su <= margin, false) THEN safe ELSE top END AS selected, coalesce(tu - su <= margin AND safe <> top, false) AS overridden FROM t LEFT JOIN s USING (o_custkey)""")
def k07(spark, sf_dir):
    margin = F.when(F.col("o_orderpriority").startswith("1"), 20000.0).when(F.col("o_orderpriority").startswith("2"), 8000.0)
    d = rewards.protected_choice(load(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", "o_totalprice", margin)
    return d.select("o_custkey", "selected", F.coalesce("overridden", F.lit(False)).alias("overridden"))


@query("x27_opening_choice", """WITH d AS (SELECT p_brand, p_partkey, p_size / 50.0 * CASE WHEN p_type LIKE '%BRASS%' THEN 1.5 ELSE 1.0 END AS raised, p_retailprice / 10000 AS intrinsic FROM part),
h AS (SELECT *, raised / max(raised) OVER (PARTITION BY p_brand) AS history FROM d)
SELECT p_brand, p_partkey, round(history, 6) AS history, round(0.5 * history + 0.35 * intrinsic, 6) AS score FROM h QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY 0.5 * history + 0.35 * intrinsic DESC, p_partkey) = 1""")
def x27(spark, sf_dir):
    d = load(spark, sf_dir, "part").withColumn("p", F.col("p_size") / 50.0).withColumn("intrinsic", F.col("p_retailprice") / 10000)
    return rewards.opening_choice(d, "p_brand", "p_partkey", "p", F.col("p_type").like("%BRASS%"), 1.5, {"search": 0.5, "intrinsic": 0.35}).select("p_brand", "p_partkey", r("history"), r("score"))


@query("x20_opening_weights", """WITH d AS (SELECT p_brand, p_partkey, round(p_size / 50.0 * CASE WHEN p_type LIKE '%BRASS%' THEN 1.5 ELSE 1.0 END, 8) AS score FROM part)
SELECT p_brand, p_partkey, score, row_number() OVER (PARTITION BY p_brand ORDER BY score DESC, p_partkey) = 1 AS selected FROM d""")
def x20(spark, sf_dir):
    d = load(spark, sf_dir, "part").withColumn("p", F.col("p_size") / 50.0)
    return rewards.opening_weighted(d, "p_brand", "p_partkey", "p", F.col("p_type").like("%BRASS%"), 1.5)


@query("p06_search_classes", """WITH s AS (SELECT user_id, event_id, event_type, event_id % 4 + 1 AS visits, value, value > 20 AS win FROM events WHERE event_type <> 'error' OR user_id % 3 <> 0),
c AS (SELECT user_id, event_id, event_type AS class_id FROM events WHERE NOT (event_type = 'view' AND user_id % 5 = 0)),
j AS (SELECT coalesce(c.user_id, s.user_id) AS user_id, class_id, visits, value, win FROM c FULL JOIN s ON c.user_id = s.user_id AND c.event_id = s.event_id),
g AS (SELECT user_id, class_id, count(visits) AS members, sum(visits)::BIGINT AS visits, sum(value) AS es, count(*) FILTER (WHERE win)::BIGINT AS wins, sum(value) FILTER (WHERE win) AS vh FROM j GROUP BY ALL),
r AS (SELECT *, es / visits AS mean_evaluation, CASE WHEN visits IS NOT NULL THEN wins / visits END AS win_rate, CASE WHEN wins > 0 THEN vh / wins END AS vm, CASE WHEN class_id IS NULL THEN 'action without class' WHEN members = 0 THEN 'class not reached' END AS problem FROM g)
SELECT user_id, class_id, members, visits, round(es, 2) AS evaluation_sum, CASE WHEN visits IS NOT NULL THEN wins END AS terminal_wins, round(vh, 2) AS victory_ending_hp_sum, problem,
row_number() OVER (PARTITION BY user_id ORDER BY problem IS NOT NULL, coalesce(win_rate, -1) DESC, coalesce(vm, -1) DESC, visits DESC NULLS LAST, mean_evaluation DESC NULLS LAST, class_id) = 1 AND problem IS NULL AS suggested FROM r""")
def p06(spark, sf_dir):
    """Events as root actions and their types as classes; some actions have no class, some classes were not reached."""
    e = load(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value")
    win = (F.col("value") > 20).cast("bigint")
    stats = e.where("event_type <> 'error' or user_id % 3 <> 0").select(
        "user_id", "event_id", (F.col("event_id") % 4 + 1).alias("visits"), F.col("value").alias("evaluation_sum"), (F.col("value") * F.col("value")).alias("evaluation_square_sum"),
        win.alias("terminal_wins"), (1 - win).alias("terminal_losses"), F.col("value").alias("ending_hp_sum"), (win * F.col("value")).alias("victory_ending_hp_sum"),
    )
    classes = e.where("not (event_type = 'view' and user_id % 5 = 0)").select("user_id", "event_id", F.col("event_type").alias("class_id"))
    d = rewards.search_classes(stats, classes, "user_id", "event_id", "class_id")
    return d.select("user_id", "class_id", "members", "visits", r("evaluation_sum", 2), "terminal_wins", F.round(F.when(F.col("terminal_wins") > 0, F.col("victory_ending_hp_sum")), 2).alias("victory_ending_hp_sum"), "problem", "suggested")


@query("j21_pivot_rates", PARTS + "SELECT p_partkey, round(max(rate) FILTER (WHERE metric = 'first_pick_rate_f1'), 6) AS first_pick_rate_f1, round(max(rate) FILTER (WHERE metric = 'first_pick_rate_f2'), 6) AS first_pick_rate_f2, min(sample_size) AS sample_size FROM long GROUP BY 1")
def j21(spark, sf_dir):
    return rewards.pivot_rates(_long(spark, sf_dir), ["p_partkey"], METRICS).select("p_partkey", r(METRICS[0]), r(METRICS[1]), "sample_size")


@query("x17_x18_x19_strategic_scores", """WITH s AS (SELECT p_partkey, p_brand, p_size / 50.0 AS f, (p_partkey % 50) / 50.0 AS d, (p_partkey % 20) / 20.0 AS o, p_partkey % 4 AS c, p_type LIKE '%TIN' AS ex FROM part),
q AS (SELECT *, CASE WHEN ex THEN 0.6 * (CASE WHEN c = 0 THEN f ELSE d * pow(0.7, greatest(c - 1, 0)) END) + 0.4 * o ELSE CASE WHEN c = 0 THEN f ELSE d * pow(0.7, greatest(c - 1, 0)) END END AS score FROM s),
t AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY score DESC, p_partkey) / count(*) OVER (PARTITION BY p_brand) AS top FROM q)
SELECT p_partkey, round(score, 6) AS score, CASE WHEN score >= 0.65 AND top <= 0.10 THEN 'premium' WHEN score >= 0.40 AND top <= 0.25 THEN 'strong' WHEN score >= 0.25 AND top <= 0.40 THEN 'reserve' ELSE 'unprotected' END AS tier,
round(least(1.0, 2.5 * o * d), 6) AS optionality, round(0.35 * score + 0.15 * least(1.0, 2.5 * o * d) - 0.08 * greatest(c - 1, 0), 6) AS utility FROM t""")
def x17(spark, sf_dir):
    c = F.col("p_partkey") % 4
    d = load(spark, sf_dir, "part").select("p_partkey", "p_brand", (F.col("p_size") / 50.0).alias("f"), (F.col("p_partkey") % 50 / 50.0).alias("d"), (F.col("p_partkey") % 20 / 20.0).alias("o"), c.alias("c"), F.col("p_type").like("%TIN").alias("ex"))
    d = d.withColumn("score", scalar.strategic_prior(F.col("f"), F.col("d"), F.col("o"), F.col("c"), F.col("ex")))
    d = rewards.top_fraction(d, ["p_brand"], "score", "p_partkey").withColumn("optionality", scalar.optionality(F.col("o"), F.col("d")))
    d = d.withColumn("utility", scalar.utility({"score": 0.35, "optionality": 0.15}, 0.08 * F.greatest(F.col("c") - 1, F.lit(0))))
    return d.select("p_partkey", r("score"), scalar.prior_tier(F.col("score"), F.col("top_fraction")).alias("tier"), r("optionality"), r("utility"))


@query("k02_argmax_tie_breaks", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC NULLS LAST, o_orderdate, o_orderkey) = 1")
def k02(spark, sf_dir):
    from decispark.sources.files import first_per_key

    return first_per_key(load(spark, sf_dir, "orders"), ["o_custkey"], [F.col("o_totalprice").desc_nulls_last(), "o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey")


@query("k03_argmin", "SELECT o_custkey, arg_min(o_orderkey, (o_totalprice, o_orderkey)) AS o_orderkey FROM orders GROUP BY 1")
def k03(spark, sf_dir):
    return load(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("o_orderkey"))


@query("w13_partition_best", "SELECT s_suppkey, s_acctbal = max(s_acctbal) OVER (PARTITION BY s_nationkey) AS best FROM supplier")
def w13(spark, sf_dir):
    from pyspark.sql import Window as W

    return load(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_acctbal") == F.max("s_acctbal").over(W.partitionBy("s_nationkey"))).alias("best"))
