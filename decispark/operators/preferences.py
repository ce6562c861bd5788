"""Preference pairs and supervised groups: screening, weights, statistics, mixtures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: In the order in which a pair meets them; the first that applies is its reason.
REASONS = ("insufficient_trials", "resource_conflict", "lower_chosen_win_count", "insufficient_adjusted_gap")


def proper_subsets(accepted: DataFrame) -> DataFrame:
    """Rows of the samples that accept some of their actions but not all."""
    w = W.partitionBy("sample")
    n = F.count(F.when(F.col("accepted"), 1)).over(w)
    return accepted.withColumn("n_accepted", n).withColumn("n_legal", F.count(F.lit(1)).over(w)).where("n_accepted > 0 and n_accepted < n_legal")


def screened(pairs: DataFrame, accepted: DataFrame, least_trials: int, se_multiplier: float, least_gap: float) -> DataFrame:
    """Pairs with exactly one accepted side as sample, chosen, rejected, gap, se, paired_trials and reason (null: it passes)."""
    side = accepted.select("sample", "action", "accepted", "wins")
    a = side.select("sample", F.col("action").alias("a"), F.col("accepted").alias("in_a"), F.col("wins").alias("wins_a"))
    b = side.select("sample", F.col("action").alias("b"), F.col("accepted").alias("in_b"), F.col("wins").alias("wins_b"))
    d = pairs.join(a, ["sample", "a"]).join(b, ["sample", "b"]).where("in_a <> in_b")
    pick = lambda x, y: F.when(F.col("in_a"), x).otherwise(y)
    d = d.select(
        "sample", pick(F.col("a"), F.col("b")).alias("chosen"), pick(F.col("b"), F.col("a")).alias("rejected"),
        pick(F.col("mean_difference"), -F.col("mean_difference")).alias("gap"), F.col("standard_error").alias("se"), "paired_trials", "conflicts",
        pick(F.col("wins_a"), F.col("wins_b")).alias("chosen_wins"), pick(F.col("wins_b"), F.col("wins_a")).alias("rejected_wins"),
    )
    tests = (F.col("paired_trials") < least_trials, F.col("conflicts") > 0, F.col("chosen_wins") < F.col("rejected_wins"), F.coalesce(F.col("gap") - se_multiplier * F.col("se") <= least_gap, F.lit(True)))
    reason: Column = F.lit(None).cast("string")
    for test, name in reversed(list(zip(tests, REASONS, strict=True))):
        reason = F.when(test, F.lit(name)).otherwise(reason)
    return d.withColumn("reason", reason)


def funnel(pairs: DataFrame) -> DataFrame:
    """How many pairs stop for each reason, and how many are kept."""
    return pairs.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("pairs"))


def arms(edges: DataFrame, coarse_gap: float, cap: float) -> DataFrame:
    """The edges of arms a (all), b (coarse only) and c (weighed by gap) with their weights within a state and the state's loss weight.

    Only states with a coarse edge take part. Weights sum to one in a state; loss weights have a mean of one in an arm.
    """
    common = edges.withColumn("coarse", F.col("gap") > coarse_gap).withColumn("any_coarse", F.max("coarse").over(W.partitionBy("sample"))).where("any_coarse")
    d = common.withColumn("arm", F.explode(F.array(F.lit("a"), F.lit("b"), F.lit("c")))).where("arm <> 'b' or coarse")
    d = d.withColumn("factor", F.when(F.col("arm") == "c", F.least(F.lit(1.0), F.col("gap") / cap)).otherwise(F.lit(1.0)))
    w = W.partitionBy("arm", "sample")
    d = d.withColumn("total", F.sum("factor").over(w)).withColumn("local", F.col("total") / F.count(F.lit(1)).over(w))
    states = d.select("arm", "sample", "local").distinct().groupBy("arm").agg(F.avg("local").alias("normalizer"))
    return d.join(F.broadcast(states), "arm").select("arm", "sample", "chosen", "rejected", "gap", (F.col("factor") / F.col("total")).alias("weight"), (F.col("local") / F.col("normalizer")).alias("loss_weight"))


def arm_statistics(edges: DataFrame, family: Column, coarse_gap: float, route: Column, ends: Column) -> DataFrame:
    """Per arm, and per arm and family: states, pairs, distinct routes, most pairs in a state, loss weights, shares of the mass in small gaps and in rejected ends of a turn."""
    mass = F.col("weight") * F.col("loss_weight")
    d = edges.withColumns({"family": family, "route": route, "small": F.when(F.col("gap") <= coarse_gap, mass).otherwise(0.0), "end": F.when(ends, mass).otherwise(0.0)})
    states = d.groupBy("arm", "family", "route", "sample").agg(F.count(F.lit(1)).alias("n"), F.first("loss_weight").alias("w"), F.sum("small").alias("small"), F.sum("end").alias("end"))
    return states.groupingSets([["arm"], ["arm", "family"]], "arm", "family").agg(
        F.count(F.lit(1)).alias("states"), F.sum("n").alias("pairs"), F.countDistinct("route").alias("routes"), F.max("n").alias("most_pairs"), F.min("w").alias("least_weight"), F.max("w").alias("most_weight"), F.sum("w").alias("weight_sum"),
        F.expr("try_divide(sum(small), sum(w))").alias("small_gap_share"), F.expr("try_divide(sum(end), sum(w))").alias("rejected_end_share"),
    )


def candidate_weights(accepted: DataFrame, heavy: Column, factor: float = 1.5) -> DataFrame:
    """Accepted actions with weights that sum to one in a state; heavy ones count `factor` times as much."""
    d = accepted.where("accepted").withColumn("raw", F.when(heavy, F.lit(factor)).otherwise(F.lit(1.0)))
    return d.select("sample", "action", (F.col("raw") / F.sum("raw").over(W.partitionBy("sample"))).alias("weight"))


def mixture_weights(rows: DataFrame, source: str, masses: dict[str, float], unit: str | None = None, unit_source: str | None = None) -> DataFrame:
    """rows with loss_weight: a source's mass over its rows; for unit_source, over its distinct units and the rows of each.

    Weights are scaled so that all rows have a mean of one.
    """
    if any(m <= 0 for m in masses.values()) or abs(sum(masses.values()) - 1) > 1e-9:
        raise ValueError("masses must be positive and sum to one")
    mass = F.create_map(*[F.lit(x) for kv in masses.items() for x in kv])
    per = rows.groupBy(source).agg(F.count(F.lit(1)).alias("n_source"), *([F.countDistinct(unit).alias("n_units")] if unit else []))
    total = rows.count()
    d = rows.join(F.broadcast(per), source).withColumn("mass", F.element_at(mass, F.col(source).cast("string")))
    plain = F.col("mass") / F.col("n_source")
    if unit:
        in_unit = F.count(F.lit(1)).over(W.partitionBy(source, unit))
        plain = F.when(F.col(source).cast("string") == unit_source, F.col("mass") / (F.col("n_units") * in_unit)).otherwise(plain)
    return d.withColumn("loss_weight", plain * total)


def branches(groups: DataFrame) -> DataFrame:
    """One row per candidate of a supervised group (id, candidates: array of action and weight)."""
    return groups.select("id", F.posexplode("candidates").alias("branch", "c")).select("id", "branch", "c.action", "c.weight")


def edge_branches(edges: DataFrame) -> DataFrame:
    """Two rows per preference edge, chosen and rejected, that share its state and weight."""
    return edges.select("*", F.expr("stack(2, 'chosen', chosen, 'rejected', rejected) as (role, action)")).drop("chosen", "rejected")


def preference_loss(chosen: Column, rejected: Column, ref_chosen: Column, ref_rejected: Column, beta: float) -> Column:
    """-log sigmoid of the scaled margin, without overflow."""
    x = beta * ((chosen - rejected) - (ref_chosen - ref_rejected))
    return F.greatest(-x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def loss_total(terms: DataFrame, by: list[str]) -> DataFrame:
    """Sum of loss times edge weight times state weight, per group."""
    return terms.groupBy(*by).agg(F.sum(F.col("loss") * F.col("weight") * F.col("loss_weight")).alias("loss"))
