"""Repeated paired trials: statistics per action, win gates, accepted sets, paired differences, stages.

A trial table has one row per state (``sample``), ``action`` and ``trial``, with an ``outcome``
(victory, defeat or aborted), ``hp`` and, where known, ``resources``. All functions take and
return DataFrames and keep one exchange by sample where they can.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

VICTORY, DEFEAT = "victory", "defeat"


def trials_of(events: DataFrame, sample: str, action: str, order: list[str], win: Column, hp: str) -> DataFrame:
    """A trial table from a log: the n-th row of each sample and action is trial n, from 0."""
    w = W.partitionBy(sample, action).orderBy(*order)
    return events.select(
        F.col(sample).alias("sample"), F.col(action).alias("action"), (F.row_number().over(w) - 1).alias("trial"),
        F.when(win, VICTORY).otherwise(DEFEAT).alias("outcome"), F.col(hp).alias("hp"),
    )


def from_records(records: DataFrame) -> DataFrame:
    """A trial table from continuation records (schema "trials"); what HP does not price is compared as resources."""
    return records.select(
        F.col("sample_id").alias("sample"), F.col("root_action").alias("action"), "trial", "outcome", F.col("ending_hp").cast("double").alias("hp"),
        F.to_json(F.struct("max_hp", "relic_counters")).alias("resources"), "decisions", "search_calls",
    )


def finished() -> Column:
    return F.col("outcome").isin(VICTORY, DEFEAT)


def carried(outcome: str = "outcome", hp: str = "hp") -> Column:
    """HP carried on: a defeat carries nothing."""
    return F.when(F.col(outcome) == VICTORY, F.col(hp)).otherwise(F.lit(0.0))


def action_stats(trials: DataFrame) -> DataFrame:
    """Per sample and action: trials, wins, win_rate, mean carried HP, mean HP of victories (null without any)."""
    won = F.col("outcome") == VICTORY
    stats = trials.groupBy("sample", "action").agg(
        F.count(F.when(finished(), 1)).alias("trials"),
        F.count(F.when(won, 1)).alias("wins"),
        F.avg(F.when(finished(), carried())).alias("expected_hp"),
        F.avg(F.when(won, F.col("hp"))).alias("victory_hp"),
    )
    return stats.withColumn("win_rate", F.expr("try_divide(wins, trials)"))


def complete_samples(trials: DataFrame, n: int) -> DataFrame:
    """Per sample whether every action has exactly n trials and every outcome is a victory or a defeat."""
    per = trials.groupBy("sample", "action").agg(F.countDistinct("trial").alias("n"), F.every(finished()).alias("fine"))
    return per.groupBy("sample").agg(F.every((F.col("n") == n) & F.col("fine")).alias("complete"))


def required_wins(rate: str, n: int) -> Column:
    """Attainable number of wins: the decimal rate times n, rounded down, without binary error."""
    return F.floor(F.lit(rate).cast("decimal(20,18)") * F.lit(n).cast("decimal(10,0)")).cast("bigint")


def win_gate(stats: DataFrame, rate: str, n: int, floor: bool = True) -> DataFrame:
    """stats with passes: at least the attainable wins in all n trials; or, not rounded, a rate of at least `rate`."""
    if floor:
        passes = (F.col("trials") == n) & (F.col("wins") >= required_wins(rate, n))
    else:
        passes = F.coalesce(F.col("win_rate") >= float(rate), F.lit(False))
    return stats.withColumn("passes", passes)


def accepted(gated: DataFrame, complete: DataFrame, tolerance: float) -> DataFrame:
    """Per sample and action whether it is accepted: it passes, the sample is complete, and its HP is within tolerance of the best that passes."""
    best = F.max(F.when(F.col("passes"), F.col("expected_hp"))).over(W.partitionBy("sample"))
    near = F.col("passes") & (F.col("best_hp") - F.col("expected_hp") <= tolerance)
    d = gated.withColumn("best_hp", best).join(complete, "sample")
    return d.withColumn("accepted", F.coalesce(near & F.col("complete"), F.lit(False)))


def paired(trials: DataFrame) -> DataFrame:
    """Per sample and pair of its actions a < b: paired trials, mean difference of carried HP, its standard error, resource conflicts.

    A pair without a common finished trial is there with 0 trials and null mean and error.
    """
    keep = [c for c in ("resources",) if c in trials.columns]
    t = trials.where(finished()).select("sample", "trial", "action", "outcome", carried().alias("carried"), *keep)
    left = t.select("sample", "trial", F.col("action").alias("a"), F.col("carried").alias("x"), F.col("outcome").alias("oa"), *[F.col(c).alias("ra") for c in keep])
    right = t.select("sample", "trial", F.col("action").alias("b"), F.col("carried").alias("y"), F.col("outcome").alias("ob"), *[F.col(c).alias("rb") for c in keep])
    both = left.join(right, ["sample", "trial"]).where("a < b").withColumn("d", F.col("x") - F.col("y"))
    conflict = (F.col("oa") == VICTORY) & (F.col("ob") == VICTORY) & ~F.col("ra").eqNullSafe(F.col("rb")) if keep else F.lit(False)
    n = F.count(F.lit(1))
    met = both.groupBy("sample", "a", "b").agg(n.alias("paired_trials"), F.avg("d").alias("mean_difference"), (F.stddev_samp("d") / F.sqrt(n)).alias("standard_error"), F.count(F.when(conflict, 1)).alias("conflicts"))
    # The actions of a sample are few, so its pairs come from one sorted array.
    names = F.array_sort(F.collect_set("action"))
    pairs = trials.groupBy("sample").agg(names.alias("names")).select("sample", F.posexplode("names").alias("i", "a"), "names").select("sample", "a", F.explode(F.slice("names", F.col("i") + 2, F.size("names"))).alias("b"))
    none = F.lit(0).cast("bigint")
    d = pairs.join(met, ["sample", "a", "b"], "left")
    return d.select("sample", "a", "b", F.coalesce("paired_trials", none).alias("paired_trials"), "mean_difference", "standard_error", F.coalesce("conflicts", none).alias("conflicts"))


def binomial_tail(wins: Column, trials: Column, p: Column) -> Column:
    """P(at least wins successes of trials at p), summed from logarithms of factorials."""
    log_choose = lambda k: _log_factorial(trials) - _log_factorial(k) - _log_factorial(trials - k)
    return F.aggregate(F.sequence(wins, trials), F.lit(0.0), lambda s, k: s + F.exp(log_choose(k) + k * F.log(p) + (trials - k) * F.log1p(-p)))


def _log_factorial(n: Column) -> Column:
    return F.when(n < 2, F.lit(0.0)).otherwise(F.aggregate(F.sequence(F.lit(2), F.greatest(n, F.lit(2)).cast("int")), F.lit(0.0), lambda s, i: s + F.log(i.cast("double"))))


def lower_bound(wins: Column, trials: Column, alpha: Column, rounds: int = 60) -> Column:
    """Exact one-sided lower bound of a success rate, by bisection; closed form where every trial is a win."""

    def halve(s: Column, _: Column) -> Column:
        middle = (s["low"] + s["high"]) / 2
        under = binomial_tail(wins, trials, middle) < alpha
        return F.struct(F.when(under, middle).otherwise(s["low"]).alias("low"), F.when(under, s["high"]).otherwise(middle).alias("high"))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.struct(F.lit(0.0).alias("low"), F.lit(1.0).alias("high")), halve, lambda s: (s["low"] + s["high"]) / 2)
    return F.when(F.coalesce(wins, F.lit(0)) == 0, F.lit(0.0)).when(wins == trials, F.pow(alpha, F.lit(1.0) / trials)).otherwise(found)


def with_lower_bound(stats: DataFrame, confidence: float) -> DataFrame:
    """stats with lcb, simultaneous over a sample's actions. Each distinct (wins, trials, actions) is solved once."""
    d = stats.withColumn("n_actions", F.count(F.lit(1)).over(W.partitionBy("sample")))
    keys = d.select("wins", "trials", "n_actions").distinct()
    solved = keys.withColumn("lcb", lower_bound(F.col("wins").cast("int"), F.col("trials").cast("int"), (1 - F.lit(confidence)) / F.greatest(F.col("n_actions"), F.lit(1))))
    return d.join(solved, ["wins", "trials", "n_actions"])


def stages(trials: DataFrame, counts: list[int], rate: str, tolerance: float) -> DataFrame:
    """Per prefix of trials (stage), sample and action: counts, cost, gate, best HP that passes and acceptance."""
    spark = trials.sparkSession
    steps = spark.createDataFrame([(c,) for c in counts], "stage int")
    t = trials.join(F.broadcast(steps), F.col("trial") < F.col("stage"))
    won = F.col("outcome") == VICTORY
    cost = F.sum("search_calls") if "search_calls" in trials.columns else F.count(F.lit(1))
    per = t.groupBy("stage", "sample", "action").agg(F.count(F.when(finished(), 1)).alias("trials"), F.count(F.when(won, 1)).alias("wins"), F.avg(F.when(finished(), carried())).alias("expected_hp"), F.count(F.lit(1)).alias("rows"), cost.alias("search_calls"))
    need = F.floor(F.lit(rate).cast("decimal(20,18)") * F.col("stage").cast("decimal(10,0)")).cast("bigint")
    full = (F.col("trials") == F.col("stage")) & (F.col("rows") == F.col("stage"))
    w = W.partitionBy("stage", "sample")
    d = per.withColumn("required", need).withColumn("passes", full & (F.col("wins") >= F.col("required"))).withColumn("complete", F.every(full).over(w))
    d = d.withColumn("best_hp", F.max(F.when(F.col("passes"), F.col("expected_hp"))).over(w))
    return d.withColumn("accepted", F.coalesce(F.col("complete") & F.col("passes") & (F.col("best_hp") - F.col("expected_hp") <= tolerance), F.lit(False)))


def stage_errors(trials: DataFrame, stage: int) -> DataFrame:
    """stage, sample, a, b and standard_error of the pairs of a prefix of trials."""
    return paired(trials.where(F.col("trial") < stage)).select(F.lit(stage).alias("stage"), "sample", "a", "b", "standard_error")


def _variance_edges(staged: DataFrame, errors: DataFrame, tolerance: float, band: float, multiplier: float) -> DataFrame:
    """stage, sample and action of passing actions whose distance from the tolerance is within multiplier times their paired error to the best one."""
    best = F.min(F.when(F.col("passes"), F.struct((-F.col("expected_hp")).alias("hp"), "action"))).over(W.partitionBy("stage", "sample"))["action"]
    d = staged.where("complete").withColumn("reference", best).where("passes and action <> reference")
    d = d.withColumns({"a": F.least("action", "reference"), "b": F.greatest("action", "reference")}).join(errors, ["stage", "sample", "a", "b"])
    lost = F.raise_error(F.concat(F.lit("no finite paired error of sample "), F.col("sample").cast("string"))).cast("double")
    error = F.when(F.isnan("standard_error") | F.col("standard_error").isNull(), lost).otherwise(F.col("standard_error"))
    return d.where(F.abs(F.col("best_hp") - F.col("expected_hp") - tolerance) <= F.greatest(F.lit(band), multiplier * error)).select("stage", "sample", "action")


def stage_decisions(staged: DataFrame, counts: list[int], tolerance: float, band: float, audit_probability: float, audit_seed: int, errors: DataFrame | None = None, se_multiplier: float = 0.0) -> DataFrame:
    """Per sample and stage: kind of set, change, boundaries, reasons, audit draw, whether to go on, stability of each action.

    errors (from stage_errors) adds, at its stage, actions near the tolerance by their paired error
    to the HP boundary. reference_sensitive: an action at the win boundary is at least as good as the best.
    """
    relevant = F.col("best_hp").isNull() | (F.col("expected_hp") >= F.col("best_hp") - tolerance - band)
    win_edge = relevant & ((F.col("wins") == F.col("required")) | (F.col("wins") == F.col("required") - 1))
    hp_edge = F.coalesce(F.col("passes") & (F.abs(F.col("best_hp") - F.col("expected_hp") - tolerance) <= band), F.lit(False))
    if errors is not None and se_multiplier > 0:
        edges = _variance_edges(staged, errors, tolerance, band, se_multiplier).withColumn("varies", F.lit(True))
        staged = staged.join(edges, ["stage", "sample", "action"], "left").withColumn("varies", F.coalesce("varies", F.lit(False)))
    else:
        staged = staged.withColumn("varies", F.lit(False))
    sensitive = F.coalesce(win_edge & (F.col("expected_hp") >= F.col("best_hp")), F.lit(False))
    names = lambda cond: F.array_sort(F.collect_list(F.when(cond, F.col("action"))))
    per = staged.where("complete").groupBy("sample", "stage").agg(
        names(F.col("accepted")).alias("candidates"), names(win_edge).alias("win_boundary"), names(hp_edge | F.col("varies")).alias("hp_boundary"), names(F.col("varies")).alias("variance_boundary"),
        F.array_sort(F.collect_list("action")).alias("actions"), F.sum("rows").alias("executions"), F.sum("search_calls").alias("search_calls"), F.some(sensitive).alias("reference_sensitive"),
    )
    before = F.lag("candidates").over(W.partitionBy("sample").orderBy("stage"))
    d = per.withColumn("previous", before).withColumn("changed", F.coalesce(F.col("previous") != F.col("candidates"), F.lit(False)))
    size = F.size("candidates")
    d = d.withColumn("kind", F.when(size == 0, "empty").when(size == F.size("actions"), "all").otherwise("proper"))
    d = d.withColumn("reasons", F.array_compact(F.array(
        F.when((F.col("stage") == counts[0]) & (F.col("kind") == "proper"), F.lit("confirm_proper_set")),
        F.when((F.col("stage") > counts[0]) & F.col("changed"), F.lit("candidate_set_changed")),
        F.when(F.size("hp_boundary") > 0, F.lit("hp_boundary")),
        F.when(F.size("win_boundary") > 0, F.lit("win_boundary")),
    )))
    from decispark.functions.scalar import hash_uniform

    draw = hash_uniform(F.concat(F.lit(f"[{audit_seed},"), F.col("sample").cast("string"), F.lit(","), F.col("stage").cast("string"), F.lit("]")))
    cap = F.col("stage") == counts[-1]
    d = d.withColumn("audit", ~cap & (F.size("reasons") == 0) & (draw < audit_probability)).withColumn("would_expand", ~cap & ((F.size("reasons") > 0) | F.col("audit")))
    old = F.coalesce("previous", "candidates")

    def status(a: Column) -> Column:
        now = F.array_contains("candidates", a)
        edge = F.array_contains(F.concat("win_boundary", "hp_boundary"), a)
        return F.concat(a, F.lit(":"), F.when(F.array_contains(old, a) != now, "flip").when(edge, "borderline").when(now, "stable_pass").otherwise("stable_fail"))

    return d.withColumn("stability", F.transform("actions", status))


def stops(decided: DataFrame) -> DataFrame:
    """The stage at which each sample stops: its first one that would not expand."""
    first = F.min(F.when(~F.col("would_expand"), F.col("stage"))).over(W.partitionBy("sample"))
    return decided.withColumn("stop", first).where("stage = stop")


def ladder_statistics(decided: DataFrame, counts: list[int], cost: str = "search_calls") -> DataFrame:
    """States, early stops, sets that still change after one and their rate, stops at each stage, and the share of the cost saved."""
    last = counts[-1]
    final = decided.where(F.col("stage") == last).select("sample", F.col("candidates").alias("final"), F.col(cost).alias("all_cost"))
    d = stops(decided).join(final, "sample", "left")
    early = F.col("stage") < last
    changed = early & F.col("final").isNotNull() & (F.col("candidates") != F.col("final"))
    out = d.agg(
        F.count(F.lit(1)).alias("states"), F.count_if(early).alias("early_stops"), F.count_if(changed).alias("changed_later"), *[F.count_if(F.col("stage") == n).alias(f"stops_{n}") for n in counts],
        F.sum(cost).alias("proposed_cost"), F.sum(F.coalesce("all_cost", F.col(cost))).alias("full_cost"),
    )
    return out.withColumn("change_rate", F.expr("try_divide(changed_later, early_stops)")).withColumn("saved", F.expr("1 - try_divide(proposed_cost, full_cost)"))


def mean_of_worlds(worlds: DataFrame, win: str, hp: str) -> DataFrame:
    """Per sample the action of highest mean win, then mean of win times HP, then lowest name; each world counts alike."""
    per = worlds.groupBy("sample", "action").agg(F.avg(win).alias("win"), F.avg(F.col(win) * F.col(hp)).alias("win_hp"))
    w = W.partitionBy("sample").orderBy(F.desc("win"), F.desc("win_hp"), "action")
    return per.withColumn("place", F.row_number().over(w)).where("place = 1").drop("place")
