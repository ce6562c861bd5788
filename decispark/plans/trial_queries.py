"""Trial statistics, accepted sets, preference pairs and tags, bound to events, orders and lineitem."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from decispark.functions import scalar
from decispark.operators import categories, preferences, trials, validation
from decispark.sources.shared import cut

from .registry import load, query

N, RATE, TOLERANCE = 3, "0.66", 5.0
T = """
WITH t AS (
  SELECT user_id * 1000000 + i // 3 AS sample, event_type AS action, i % 3 AS trial,
         CASE WHEN value > 20 THEN 'victory' ELSE 'defeat' END AS outcome, value AS hp, CASE WHEN value > 20 THEN value ELSE 0 END AS carried, (floor(value)::BIGINT % 5 + 1) AS search_calls
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1 AS i FROM events)),
stats AS (
  SELECT sample, action, count(*) AS trials, count(*) FILTER (WHERE outcome = 'victory') AS wins, avg(carried) AS expected_hp,
         avg(hp) FILTER (WHERE outcome = 'victory') AS victory_hp, count(*) FILTER (WHERE outcome = 'victory') / count(*) AS win_rate
  FROM t GROUP BY ALL),
complete AS (SELECT sample, bool_and(n = 3) AS complete FROM (SELECT sample, action, count(DISTINCT trial) AS n FROM t GROUP BY ALL) GROUP BY sample),
gated AS (SELECT *, trials = 3 AND wins >= floor(0.66::DECIMAL(20,18) * 3) AS passes FROM stats),
best AS (SELECT g.*, c.complete, max(expected_hp) FILTER (WHERE passes) OVER (PARTITION BY sample) AS best_hp FROM gated g JOIN complete c USING (sample)),
acc AS (SELECT *, coalesce(complete AND passes AND best_hp - expected_hp <= 5.0, false) AS accepted FROM best),
met AS (
  SELECT a.sample, a.action AS a, b.action AS b, count(*) AS paired_trials, avg(a.carried - b.carried) AS mean_difference,
         stddev_samp(a.carried - b.carried) / sqrt(count(*)) AS standard_error,
         count(*) FILTER (WHERE a.outcome = 'victory' AND b.outcome = 'victory' AND floor(a.hp / 50) <> floor(b.hp / 50)) AS conflicts
  FROM t a JOIN t b ON a.sample = b.sample AND a.trial = b.trial AND a.action < b.action GROUP BY ALL),
names AS (SELECT DISTINCT sample, action FROM t),
pairs AS (
  SELECT x.sample, x.action AS a, y.action AS b, coalesce(paired_trials, 0) AS paired_trials, mean_difference, standard_error, coalesce(conflicts, 0) AS conflicts
  FROM names x JOIN names y ON x.sample = y.sample AND x.action < y.action LEFT JOIN met ON met.sample = x.sample AND met.a = x.action AND met.b = y.action),
screen AS (
  SELECT p.sample, CASE WHEN x.accepted THEN a ELSE b END AS chosen, CASE WHEN x.accepted THEN b ELSE a END AS rejected,
         CASE WHEN x.accepted THEN mean_difference ELSE -mean_difference END AS gap, standard_error AS se, paired_trials, conflicts,
         CASE WHEN x.accepted THEN x.wins ELSE y.wins END AS chosen_wins, CASE WHEN x.accepted THEN y.wins ELSE x.wins END AS rejected_wins
  FROM pairs p JOIN acc x ON x.sample = p.sample AND x.action = a JOIN acc y ON y.sample = p.sample AND y.action = b WHERE x.accepted <> y.accepted),
reasons AS (
  SELECT *, CASE WHEN paired_trials < 3 THEN 'insufficient_trials' WHEN conflicts > 0 THEN 'resource_conflict' WHEN chosen_wins < rejected_wins THEN 'lower_chosen_win_count'
                 WHEN coalesce(gap - 0.5 * se <= 1.0, true) THEN 'insufficient_adjusted_gap' END AS reason FROM screen),
common AS (SELECT *, gap > 30 AS coarse FROM reasons WHERE reason IS NULL QUALIFY max(gap > 30) OVER (PARTITION BY sample)),
armed AS (SELECT arm, c.*, CASE WHEN arm = 'c' THEN least(1.0, gap / 50) ELSE 1.0 END AS factor FROM common c CROSS JOIN (VALUES ('a'), ('b'), ('c')) v(arm) WHERE arm <> 'b' OR coarse),
local AS (SELECT *, sum(factor) OVER w AS total, sum(factor) OVER w / count(*) OVER w AS local FROM armed WINDOW w AS (PARTITION BY arm, sample)),
normal AS (SELECT arm, avg(local) AS normalizer FROM (SELECT DISTINCT arm, sample, local FROM local) GROUP BY arm),
arms AS (SELECT arm, sample, chosen, rejected, gap, factor / total AS weight, local / normalizer AS loss_weight FROM local JOIN normal USING (arm))
"""


def _trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event is a trial: N in a row of a user and type belong to one sample, numbered by user and round."""
    d = trials.trials_of(load(spark, sf_dir, "events"), "user_id", "event_type", ["ts", "event_id"], F.col("value") > 20, "value")
    d = d.withColumn("sample", F.col("sample") * 1_000_000 + F.floor(F.col("trial") / N)).withColumn("trial", F.col("trial") % N)
    return d.withColumns({"resources": F.floor(F.col("hp") / 50), "search_calls": F.floor("hp") % 5 + 1})


def _stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trials.action_stats(_trials(spark, sf_dir))


def _accepted_of(t: DataFrame) -> DataFrame:
    return trials.accepted(trials.win_gate(trials.action_stats(t), RATE, N), trials.complete_samples(t, N), TOLERANCE)


def _accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _accepted_of(_trials(spark, sf_dir))


def _screened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trials and the accepted set, each used more than once, are written first."""
    t = cut(_trials(spark, sf_dir), "trials")
    return preferences.screened(trials.paired(t), cut(_accepted_of(t), "accepted"), N, 0.5, 1.0)


def _arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preferences.arms(_screened(spark, sf_dir).where("reason is null"), 30.0, 50.0)


def r(name: str, digits: int = 6) -> Column:
    return F.round(name, digits).alias(name)


@query("a01_action_trial_stats", T + "SELECT sample, action, trials, wins, round(expected_hp, 6) AS expected_hp, round(victory_hp, 6) AS victory_hp, round(win_rate, 6) AS win_rate FROM stats")
def a01(spark, sf_dir):
    return _stats(spark, sf_dir).select("sample", "action", "trials", "wins", r("expected_hp"), r("victory_hp"), r("win_rate"))


@query("a02_complete_samples", T + "SELECT sample, complete FROM complete")
def a02(spark, sf_dir):
    return trials.complete_samples(_trials(spark, sf_dir), N)


@query("a03_binomial_lower_bound", T + """, k AS (SELECT DISTINCT wins, trials, count(*) OVER (PARTITION BY sample) AS n_actions FROM stats)
SELECT wins, trials, n_actions, CASE WHEN wins = 0 THEN 0.0 ELSE round(pow(0.05 / n_actions, 1.0 / trials), 9) END AS lcb FROM k WHERE wins = 0 OR wins = trials""")
def a03(spark, sf_dir):
    d = trials.with_lower_bound(_stats(spark, sf_dir), 0.95).where("wins = 0 or wins = trials")
    return d.select("wins", "trials", "n_actions", r("lcb", 9)).distinct()


@query("a03_lower_bound_gate", T + "SELECT sample, action, wins, trials, CASE WHEN wins = 0 THEN 1.0 ELSE round(0.05 / count(*) OVER (PARTITION BY sample), 6) END AS tail FROM stats")
def a03_gate(spark, sf_dir):
    """The chance of at least as many wins at the bound, summed anew term by term, is the error allowed."""
    d = trials.with_lower_bound(_stats(spark, sf_dir), 0.95)
    n, w, p = F.col("trials").cast("int"), F.col("wins").cast("int"), F.col("lcb")
    choose = lambda k: F.factorial(n) / (F.factorial(k) * F.factorial(n - k))
    tail = F.aggregate(F.sequence(w, n), F.lit(0.0), lambda s, k: s + choose(k) * F.pow(p, k) * F.pow(1 - p, n - k))
    return d.select("sample", "action", "wins", "trials", F.round(tail, 6).alias("tail"))


@query("a04_win_gate", T + "SELECT sample, action, trials, wins, passes FROM gated")
def a04(spark, sf_dir):
    return trials.win_gate(_stats(spark, sf_dir), RATE, N).select("sample", "action", "trials", "wins", "passes")


@query("a04_exact_gate", T + "SELECT sample, action, coalesce(win_rate >= 0.66, false) AS passes FROM stats")
def a04_exact(spark, sf_dir):
    return trials.win_gate(_stats(spark, sf_dir), RATE, N, floor=False).select("sample", "action", "passes")


@query("a05_accepted_set", T + "SELECT sample, action, round(expected_hp, 6) AS expected_hp, round(best_hp, 6) AS best_hp, accepted FROM acc")
def a05(spark, sf_dir):
    return _accepted(spark, sf_dir).select("sample", "action", r("expected_hp"), r("best_hp"), "accepted")


@query("a06_j01_paired_trials", T + "SELECT sample, a, b, paired_trials, round(mean_difference, 6) AS mean_difference, round(standard_error, 6) AS standard_error, conflicts FROM pairs")
def a06(spark, sf_dir):
    return trials.paired(_trials(spark, sf_dir)).select("sample", "a", "b", "paired_trials", r("mean_difference"), r("standard_error"), "conflicts")


@query("a07_mean_of_worlds", T + """, w AS (SELECT sample, action, avg((outcome = 'victory')::INT) AS win, avg((outcome = 'victory')::INT * hp) AS win_hp FROM t GROUP BY ALL)
SELECT sample, action, round(win, 6) AS win, round(win_hp, 6) AS win_hp FROM w QUALIFY row_number() OVER (PARTITION BY sample ORDER BY win DESC, win_hp DESC, action) = 1""")
def a07(spark, sf_dir):
    d = _trials(spark, sf_dir).withColumn("win", (F.col("outcome") == "victory").cast("int"))
    return trials.mean_of_worlds(d, "win", "hp").select("sample", "action", r("win"), r("win_hp"))


STAGES = [1, 2, 3]
ST = T + """, st AS (
  SELECT stage, sample, action, count(*) AS rows_, count(*) FILTER (WHERE outcome = 'victory') AS wins, avg(carried) AS expected_hp, floor(0.66::DECIMAL(20,18) * stage) AS required, sum(search_calls) AS calls
  FROM t JOIN (VALUES (1), (2), (3)) v(stage) ON trial < stage GROUP BY ALL),
sg AS (SELECT *, rows_ = stage AND wins >= required AS passes, bool_and(rows_ = stage) OVER (PARTITION BY stage, sample) AS complete FROM st),
sb AS (SELECT *, max(expected_hp) FILTER (WHERE passes) OVER (PARTITION BY stage, sample) AS best_hp FROM sg),
sa AS (SELECT *, coalesce(complete AND passes AND best_hp - expected_hp <= 5.0, false) AS accepted FROM sb),
ref AS (SELECT stage, sample, arg_min(action, (-expected_hp, action)) FILTER (WHERE passes) AS reference FROM sa GROUP BY ALL),
se AS (SELECT a.sample, a.action AS x, b.action AS y, stddev_samp(a.carried - b.carried) / sqrt(count(*)) AS se FROM t a JOIN t b ON a.sample = b.sample AND a.trial = b.trial AND a.action <> b.action WHERE a.trial < 2 GROUP BY ALL),
sv AS (
  SELECT sa.*, coalesce(stage = 2 AND passes AND action <> reference AND abs(best_hp - expected_hp - 5.0) <= greatest(1.0, 0.5 * se), false) AS varies,
         best_hp IS NULL OR expected_hp >= best_hp - 6.0 AS relevant
  FROM sa JOIN ref USING (stage, sample) LEFT JOIN se ON se.sample = sa.sample AND x = reference AND y = action),
dec0 AS (
  SELECT sample, stage, coalesce(string_agg(action, ',' ORDER BY action) FILTER (WHERE accepted), '') AS candidates,
         coalesce(string_agg(action, ',' ORDER BY action) FILTER (WHERE relevant AND (wins = required OR wins = required - 1)), '') AS win_boundary,
         coalesce(string_agg(action, ',' ORDER BY action) FILTER (WHERE passes AND (varies OR abs(best_hp - expected_hp - 5.0) <= 1.0)), '') AS hp_boundary,
         coalesce(string_agg(action, ',' ORDER BY action) FILTER (WHERE varies), '') AS variance_boundary,
         coalesce(bool_or(relevant AND (wins = required OR wins = required - 1) AND expected_hp >= best_hp), false) AS reference_sensitive,
         count(*) AS n, count(*) FILTER (WHERE accepted) AS n_acc, sum(rows_)::BIGINT AS executions, sum(calls)::BIGINT AS search_calls,
         list(action ORDER BY action) AS actions
  FROM sv WHERE complete GROUP BY ALL),
dec1 AS (SELECT *, coalesce(lag(candidates) OVER (PARTITION BY sample ORDER BY stage) <> candidates, false) AS changed, CASE WHEN n_acc = 0 THEN 'empty' WHEN n_acc = n THEN 'all' ELSE 'proper' END AS kind FROM dec0),
dec2 AS (
  SELECT *, concat_ws(',', CASE WHEN stage = 1 AND kind = 'proper' THEN 'confirm_proper_set' END, CASE WHEN stage > 1 AND changed THEN 'candidate_set_changed' END,
                      CASE WHEN hp_boundary <> '' THEN 'hp_boundary' END, CASE WHEN win_boundary <> '' THEN 'win_boundary' END) AS reasons,
         ('0x' || substr(sha256('[7,' || sample || ',' || stage || ']'), 1, 16))::UBIGINT::DOUBLE / pow(2.0, 64) AS draw FROM dec1),
dec AS (SELECT *, stage <> 3 AND reasons = '' AND draw < 0.2 AS audit, stage <> 3 AND (reasons <> '' OR (reasons = '' AND draw < 0.2)) AS would_expand FROM dec2)
"""


def _decisions(spark, sf_dir):
    t = cut(_trials(spark, sf_dir), "trials")
    return trials.stage_decisions(trials.stages(t, STAGES, RATE, TOLERANCE), STAGES, TOLERANCE, 1.0, 0.2, 7, trials.stage_errors(t, STAGES[1]), 0.5)


@query("a13_prefix_stages", ST + "SELECT stage, sample, action, wins, round(expected_hp, 6) AS expected_hp, passes, accepted FROM sa")
def a13(spark, sf_dir):
    return trials.stages(_trials(spark, sf_dir), STAGES, RATE, TOLERANCE).select("stage", "sample", "action", "wins", r("expected_hp"), "passes", "accepted")


@query("a12_w09_stage_decisions", ST + "SELECT sample, stage, candidates, win_boundary, hp_boundary, variance_boundary, reference_sensitive, kind, changed, reasons, audit, would_expand, executions, search_calls FROM dec")
def a12(spark, sf_dir):
    text = lambda c: F.array_join(c, ",").alias(c)
    d = _decisions(spark, sf_dir)
    return d.select("sample", "stage", text("candidates"), text("win_boundary"), text("hp_boundary"), text("variance_boundary"), "reference_sensitive", "kind", "changed", text("reasons"), "audit", "would_expand", "executions", "search_calls")


@query("a14_q05_ladder_statistics", ST + """, stops AS (SELECT * FROM dec QUALIFY stage = min(stage) FILTER (WHERE NOT would_expand) OVER (PARTITION BY sample)),
fin AS (SELECT sample, candidates AS final, search_calls AS all_cost FROM dec WHERE stage = 3),
x AS (SELECT *, stage < 3 AS early, stage < 3 AND candidates <> final AS moved FROM stops LEFT JOIN fin USING (sample))
SELECT count(*) AS states, count(*) FILTER (WHERE early) AS early_stops, count(*) FILTER (WHERE moved) AS changed_later, round(count(*) FILTER (WHERE moved) / nullif(count(*) FILTER (WHERE early), 0), 6) AS change_rate,
       count(*) FILTER (WHERE stage = 1) AS stops_1, count(*) FILTER (WHERE stage = 2) AS stops_2, count(*) FILTER (WHERE stage = 3) AS stops_3,
       sum(search_calls)::BIGINT AS proposed_cost, sum(coalesce(all_cost, search_calls))::BIGINT AS full_cost, round(1 - sum(search_calls) / sum(coalesce(all_cost, search_calls)), 6) AS saved FROM x""")
def a14(spark, sf_dir):
    return trials.ladder_statistics(_decisions(spark, sf_dir), STAGES).withColumn("saved", F.round("saved", 6)).withColumn("change_rate", F.round("change_rate", 6))


@query("a12_action_stability", ST + """, old AS (SELECT sample, stage, actions, candidates, win_boundary || ',' || hp_boundary AS edge, coalesce(lag(candidates) OVER (PARTITION BY sample ORDER BY stage), candidates) AS before FROM dec),
each AS (SELECT sample, stage, unnest(actions) AS action, string_split(candidates, ',') AS now, string_split(before, ',') AS was, string_split(edge, ',') AS edge FROM old)
SELECT sample, stage, string_agg(action || ':' || CASE WHEN list_contains(was, action) <> list_contains(now, action) THEN 'flip' WHEN list_contains(edge, action) THEN 'borderline' WHEN list_contains(now, action) THEN 'stable_pass' ELSE 'stable_fail' END, ',' ORDER BY action) AS stability FROM each GROUP BY ALL""")
def a12_stability(spark, sf_dir):
    return _decisions(spark, sf_dir).select("sample", "stage", F.array_join("stability", ",").alias("stability"))


@query("f03_proper_subsets", T + "SELECT sample, action, accepted FROM acc WINDOW w AS (PARTITION BY sample) QUALIFY count(*) FILTER (WHERE accepted) OVER w > 0 AND count(*) FILTER (WHERE accepted) OVER w < count(*) OVER w")
def f03(spark, sf_dir):
    return preferences.proper_subsets(_accepted(spark, sf_dir)).select("sample", "action", "accepted")


@query("f02_screening", T + "SELECT sample, chosen, rejected, round(gap, 6) AS gap, paired_trials, reason FROM reasons")
def f02(spark, sf_dir):
    return _screened(spark, sf_dir).select("sample", "chosen", "rejected", r("gap"), "paired_trials", "reason")


@query("a16_screening_funnel", T + "SELECT coalesce(reason, 'kept') AS reason, count(*) AS pairs FROM reasons GROUP BY 1")
def a16(spark, sf_dir):
    return preferences.funnel(_screened(spark, sf_dir))


@query("a28_candidate_weights", T + ", w AS (SELECT sample, action, CASE WHEN action <> 'click' THEN 1.5 ELSE 1.0 END AS raw FROM acc WHERE accepted) SELECT sample, action, round(raw / sum(raw) OVER (PARTITION BY sample), 9) AS weight FROM w")
def a28(spark, sf_dir):
    return preferences.candidate_weights(_accepted(spark, sf_dir), F.col("action") != "click").select("sample", "action", r("weight", 9))


@query("a29_preference_weights", T + "SELECT arm, sample, chosen, rejected, round(gap, 6) AS gap, round(weight, 6) AS weight, round(loss_weight, 6) AS loss_weight FROM arms")
def a29(spark, sf_dir):
    return _arms(spark, sf_dir).select("arm", "sample", "chosen", "rejected", r("gap"), r("weight"), r("loss_weight"))


@query("a15_preference_statistics", T + """, s AS (SELECT arm, (sample % 3)::INT AS family, sample % 7 AS route, sample, count(*) AS n, first(loss_weight) AS w, sum(CASE WHEN gap <= 30 THEN weight * loss_weight ELSE 0 END) AS small, sum(CASE WHEN rejected = 'view' THEN weight * loss_weight ELSE 0 END) AS ends FROM arms GROUP BY ALL)
SELECT arm, family, count(*) AS states, sum(n)::BIGINT AS pairs, count(DISTINCT route) AS routes, max(n) AS most_pairs, round(min(w), 6) AS least_weight, round(max(w), 6) AS most_weight, round(sum(w), 6) AS weight_sum, round(sum(small) / sum(w), 6) AS small_gap_share, round(sum(ends) / sum(w), 6) AS rejected_end_share FROM s GROUP BY GROUPING SETS ((arm), (arm, family))""")
def a15(spark, sf_dir):
    d = preferences.arm_statistics(_arms(spark, sf_dir), (F.col("sample") % 3).cast("int"), 30.0, F.col("sample") % 7, F.col("rejected") == "view")
    return d.select("arm", "family", "states", "pairs", "routes", "most_pairs", r("least_weight"), r("most_weight"), r("weight_sum"), r("small_gap_share"), r("rejected_end_share"))


@query("v12_pair_completeness", T + ", n AS (SELECT sample, count(DISTINCT action) AS n FROM t GROUP BY 1) SELECT sample, count(*) AS pairs, count(*) AS distinct_pairs, max(n) AS n FROM pairs JOIN n USING (sample) WHERE NOT (sample % 5 = 0 AND a = 'click') GROUP BY sample HAVING count(*) <> max(n) * (max(n) - 1) / 2")
def v12(spark, sf_dir):
    """Samples that lack pairs: of one in five, those of one action are left out."""
    t = _trials(spark, sf_dir)
    n = t.groupBy("sample").agg(F.countDistinct("action").alias("n_actions"))
    return validation.pair_completeness(trials.paired(t).where("not (sample % 5 = 0 and a = 'click')").join(n, "sample"), "sample", "a", "b", "n_actions")


@query("v05_mean_one_weights", T + ", s AS (SELECT DISTINCT arm, sample, loss_weight FROM arms) SELECT arm, count(*) AS states, round(avg(loss_weight), 6) AS mean FROM s GROUP BY arm")
def v05(spark, sf_dir):
    s = _arms(spark, sf_dir).select("arm", "sample", "loss_weight").distinct()
    return s.groupBy("arm").agg(F.count(F.lit(1)).alias("states"), F.round(F.avg("loss_weight"), 6).alias("mean"))


@query("v16_recompute_and_compare", T + "SELECT side, sample, action, wins + (side = 'left only')::INT AS wins FROM stats, (VALUES ('left only'), ('right only')) v(side) WHERE sample % 10 = 0")
def v16(spark, sf_dir):
    """Reported statistics, one in ten samples with a win too many, against recomputed ones by another path."""
    from decispark.operators import joins

    reported = _stats(spark, sf_dir).select("sample", "action", (F.col("wins") + (F.col("sample") % 10 == 0).cast("bigint")).alias("wins"))
    again = _trials(spark, sf_dir).groupBy("sample", "action").agg(F.sum((F.col("outcome") == "victory").cast("bigint")).alias("wins"))
    return joins.row_differences(reported, again)


@query("t17_edge_branches", T + "SELECT arm, sample, role, action, round(weight, 6) AS weight FROM (SELECT arm, sample, 'chosen' AS role, chosen AS action, weight FROM arms UNION ALL SELECT arm, sample, 'rejected', rejected, weight FROM arms)")
def t17(spark, sf_dir):
    return preferences.edge_branches(_arms(spark, sf_dir)).select("arm", "sample", "role", "action", r("weight"))


LOSS = "greatest(-x, 0) + ln(1 + exp(-abs(x)))"


@query("x23_x29_preference_loss", T + f", l AS (SELECT arm, weight, loss_weight, 0.1 * gap AS x FROM arms) SELECT arm, round(sum(({LOSS}) * weight * loss_weight), 5) AS loss FROM l GROUP BY arm")
def x23(spark, sf_dir):
    zero = F.lit(0.0)
    d = _arms(spark, sf_dir).withColumn("loss", preferences.preference_loss(F.col("gap"), zero, zero, zero, 0.1))
    return preferences.loss_total(d, ["arm"]).select("arm", F.round("loss", 5).alias("loss"))


# tags: an order is a state, its line items are items

TAGS = "list_filter(['flag_' || l_returnflag, 'status_' || l_linestatus, CASE WHEN l_quantity > 25 THEN 'large' END], lambda x: x IS NOT NULL)"


def _tags() -> Column:
    return F.array_compact(F.array(F.concat(F.lit("flag_"), F.col("l_returnflag")), F.concat(F.lit("status_"), F.col("l_linestatus")), F.when(F.col("l_quantity") > 25, F.lit("large"))))


@query("a08_x15_state_equal_shares", f"""WITH i AS (SELECT l_orderkey, {TAGS} AS tags, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem),
e AS (SELECT l_orderkey, n, unnest(tags) AS tag FROM i), s AS (SELECT count(DISTINCT l_orderkey) AS states FROM lineitem)
SELECT tag, round(sum(1.0 / n) / max(states), 6) AS share, count(*) AS items FROM e, s GROUP BY tag""")
def a08(spark, sf_dir):
    return categories.state_equal_shares(load(spark, sf_dir, "lineitem"), "l_orderkey", _tags()).select("tag", r("share"), "items")


@query("a09_retention", f"""WITH e AS (SELECT l_orderkey, unnest({TAGS}) AS tag, (l_discount >= 0.05)::INT AS kept FROM lineitem),
s AS (SELECT l_orderkey, tag, count(*) AS offered, sum(kept) AS kept FROM e GROUP BY ALL)
SELECT tag, count(*) AS opportunity_states, count(*) FILTER (WHERE kept > 0) AS retained_states, round(avg(kept / offered), 6) AS mean_retention, round(count(*) FILTER (WHERE kept > 0) / count(*), 6) AS retained_rate FROM s GROUP BY tag""")
def a09(spark, sf_dir):
    d = categories.retention(load(spark, sf_dir, "lineitem"), "l_orderkey", _tags(), F.col("l_discount") >= 0.05)
    return d.select("tag", "opportunity_states", "retained_states", r("mean_retention"), r("retained_rate"))


@query("a10_a11_quality_counts", """WITH o AS (SELECT l_orderkey, any_value(l_returnflag) AS x, count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'R') AS k, (l_orderkey % 4)::INT AS family FROM lineitem GROUP BY l_orderkey)
SELECT CASE WHEN grouping(family) = 1 THEN 'all' ELSE 'family' END AS view, family, count(*) AS states, count(*) FILTER (WHERE k = 0) AS empty, count(*) FILTER (WHERE k = 1) AS single, count(*) FILTER (WHERE k = n) AS all_kept, count(*) FILTER (WHERE n = 1) AS one_item
FROM o GROUP BY GROUPING SETS ((), (family))""")
def a10(spark, sf_dir):
    per = load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("l_returnflag") == "R", 1)).alias("k")).withColumn("family", (F.col("l_orderkey") % 4).cast("int"))
    k, n = F.col("k"), F.col("n")
    return categories.quality_counts(per, {"empty": k == 0, "single": k == 1, "all_kept": k == n, "one_item": n == 1}, "family")


@query("f07_u07_last_of_each", "SELECT l_orderkey, l_partkey, l_suppkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY l_linenumber DESC, l_shipdate DESC, l_suppkey DESC) = 1")
def f07(spark, sf_dir):
    d = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_shipdate", "l_suppkey")
    return categories.last_of_each(d, ["l_orderkey", "l_partkey"], ["l_linenumber", "l_shipdate", "l_suppkey"]).select("l_orderkey", "l_partkey", "l_suppkey")


@query("a22_ratio_of_sums", """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_l_quantity, round(sum(l_extendedprice) / nullif(sum(l_quantity), 0), 6) AS unit_price, round(sum(l_tax) / nullif(sum(l_discount), 0), 6) AS tax_per_discount FROM lineitem GROUP BY ALL""")
def a22(spark, sf_dir):
    d = categories.ratio_of_sums(load(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], {"unit_price": ("l_extendedprice", "l_quantity"), "tax_per_discount": ("l_tax", "l_discount")})
    return d.select("l_returnflag", "l_linestatus", F.round("sum_l_quantity", 2).alias("sum_l_quantity"), r("unit_price"), r("tax_per_discount"))


@query("a24_rendered_counts", """WITH c AS (SELECT l_orderkey, l_returnflag || l_linestatus AS v, count(*) AS n FROM lineitem GROUP BY ALL) SELECT l_orderkey, string_agg(v || ' x' || n, ', ' ORDER BY v || ' x' || n) AS counts FROM c GROUP BY 1""")
def a24(spark, sf_dir):
    return categories.rendered_counts(load(spark, sf_dir, "lineitem"), ["l_orderkey"], F.concat("l_returnflag", "l_linestatus"))


@query("a25_a35_tallies", "SELECT o_orderstatus, split_part(o_orderpriority, '-', 1) AS value, count(*) AS n FROM orders GROUP BY ALL")
def a25(spark, sf_dir):
    return categories.tally(load(spark, sf_dir, "orders"), ["o_orderstatus"], F.split_part("o_orderpriority", F.lit("-"), F.lit(1)))


@query("a36_semantic_metrics", """SELECT CASE WHEN grouping(event_type) = 1 THEN 'all' ELSE 'family' END AS view, event_type AS family, count(*) AS states, count(*) FILTER (WHERE value > 20) AS matched, count(*) FILTER (WHERE value > 100) AS large FROM events GROUP BY GROUPING SETS ((), (event_type))""")
def a36(spark, sf_dir):
    return categories.quality_counts(load(spark, sf_dir, "events"), {"matched": F.col("value") > 20, "large": F.col("value") > 100}, "event_type")


@query("a37_wilson_interval", T + """SELECT sample, action, round(((wins / trials + 3.8414588206941285 / (2 * trials)) - 1.959963984540054 * sqrt((wins / trials) * (1 - wins / trials) / trials + 3.8414588206941285 / (4.0 * trials * trials))) / (1 + 3.8414588206941285 / trials), 6) AS low,
 round(((wins / trials + 3.8414588206941285 / (2 * trials)) + 1.959963984540054 * sqrt((wins / trials) * (1 - wins / trials) / trials + 3.8414588206941285 / (4.0 * trials * trials))) / (1 + 3.8414588206941285 / trials), 6) AS high FROM stats""")
def a37(spark, sf_dir):
    d = _stats(spark, sf_dir).withColumn("w", scalar.wilson(F.col("wins"), F.col("trials")))
    return d.select("sample", "action", F.round("w.low", 6).alias("low"), F.round("w.high", 6).alias("high"))


@query("a37_exact_sign_test", T + """, m AS (SELECT a, b, count(*) FILTER (WHERE mean_difference > 0) AS better, count(*) FILTER (WHERE mean_difference <> 0) AS n FROM pairs GROUP BY ALL)
SELECT a, b, better, n, round(CASE WHEN n = 0 THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(range(0, least(better, n - better) + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2.0))))) END, 9) AS p FROM m""")
def a37_sign(spark, sf_dir):
    t = trials.paired(_trials(spark, sf_dir)).groupBy("a", "b").agg(F.count(F.when(F.col("mean_difference") > 0, 1)).alias("better"), F.count(F.when(F.col("mean_difference") != 0, 1)).alias("n"))
    return t.select("a", "b", "better", "n", F.round(scalar.exact_two_sided(F.col("better"), F.col("n")), 9).alias("p"))


@query("a37_cluster_bootstrap", """WITH per AS (SELECT user_id, sum(value) AS total, count(value) AS n, row_number() OVER (ORDER BY user_id) - 1 AS place FROM events GROUP BY 1), c AS (SELECT count(*) AS c FROM per),
draws AS (SELECT r AS replicate, floor(('0x' || substr(sha256('11|' || r || '|' || i), 1, 16))::UBIGINT::DOUBLE / pow(2.0, 64) * c)::BIGINT AS place FROM range(50) x(r), c, range(c) y(i))
SELECT replicate, round(sum(total) / sum(n), 6) AS mean FROM draws JOIN per USING (place) GROUP BY 1""")
def a37_bootstrap(spark, sf_dir):
    from decispark.operators import sampling

    return sampling.bootstrap(load(spark, sf_dir, "events"), "user_id", "value", 50, 11).select("replicate", r("mean"))
