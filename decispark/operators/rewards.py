"""Reward choices: rate tables, choice distributions, priors, search components and selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from decispark.functions.scalar import hash_uniform


def unpivot_rates(rates: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """One row per key and metric with its rate; null rates stay."""
    return rates.unpivot(keys, metrics, "metric", "rate")


def rate_quality(long: DataFrame, size: str | None = None) -> DataFrame:
    """Per metric: rows, nulls, rates at 0 and at 1, and the range of sample sizes."""
    extra = [F.min(size).alias("least_size"), F.max(size).alias("most_size")] if size else []
    return long.groupBy("metric").agg(F.count(F.lit(1)).alias("rows"), F.count(F.when(F.col("rate").isNull(), 1)).alias("nulls"), F.count(F.when(F.col("rate") == 0, 1)).alias("zeros"), F.count(F.when(F.col("rate") == 1, 1)).alias("ones"), *extra)


def coverage_gaps(scope: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of the scope that found lacks."""
    return scope.select(*keys).distinct().join(found.select(*keys).distinct(), keys, "left_anti")


def offered_rates(offers: DataFrame, long: DataFrame, keys: list[str], metric: Column, least_size: int, fallback: float) -> DataFrame:
    """offers with target_rate and rate_source: the rate of the metric each offer asks for, or the fallback where it is missing or rests on too few."""
    o = offers.withColumn("metric", metric)
    usable = F.col("rate").isNotNull() & (F.col("sample_size") >= least_size)
    d = o.join(long.select(*keys, "metric", "rate", "sample_size"), [*keys, "metric"], "left")
    return d.withColumn("target_rate", F.when(usable, F.col("rate")).otherwise(F.lit(fallback))).withColumn("rate_source", F.concat(F.when(usable, "database").otherwise("fallback_probability"), F.lit(":"), F.col("metric"))).drop("rate", "sample_size")


def choice_distribution(offers: DataFrame, group: str, choice: str, rate: str, epsilon: float, skip: str = "SKIP") -> DataFrame:
    """Probabilities of each group's choices with a skip row: rates as they are up to 1 - epsilon in sum, else scaled to it."""
    total = offers.groupBy(group).agg(F.sum(rate).alias("total"))
    fits = F.col("total") <= 1 - epsilon
    d = offers.select(group, choice, rate).join(total, group)
    cards = d.select(group, F.col(choice).alias("choice"), F.lit(0).alias("last"), F.col(rate).alias("raw"), F.when(fits, F.col(rate)).otherwise((1 - epsilon) * F.col(rate) / F.col("total")).alias("probability"))
    rest = total.select(group, F.lit(skip).alias("choice"), F.lit(1).alias("last"), F.when(fits, 1 - F.col("total")).otherwise(F.lit(epsilon)).alias("raw"), F.when(fits, 1 - F.col("total")).otherwise(F.lit(epsilon)).alias("probability"))
    return cards.unionByName(rest)


def inverse_cdf(mass: DataFrame, group: str, order: list[str], p: str, key: Column) -> DataFrame:
    """The row of each group at which the running mass first exceeds the group's draw; the last row where rounding leaves none."""
    w = W.partitionBy(group).orderBy(*order)
    total = F.sum(p).over(W.partitionBy(group))
    d = mass.withColumn("cum", F.sum(p).over(w.rowsBetween(W.unboundedPreceding, 0)) / total).withColumn("place", F.row_number().over(w)).withColumn("u", hash_uniform(key))
    hit = d.withColumn("hit", F.col("cum") > F.col("u"))
    first = W.partitionBy(group).orderBy(F.desc("hit"), F.when(F.col("hit"), F.col("place")).otherwise(-F.col("place")))
    return hit.withColumn("pick", F.row_number().over(first)).where("pick = 1").drop("hit", "pick")


def top_fraction(scored: DataFrame, group: list[str], score: str, name: str) -> DataFrame:
    """scored with top_fraction: place by falling score, then name, over the number of rows."""
    w = W.partitionBy(*group)
    return scored.withColumn("top_fraction", F.row_number().over(w.orderBy(F.desc(score), name)) / F.count(F.lit(1)).over(w))


def normalized_rank(scored: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """scored with rank from 0 to 1 by rising order."""
    w = W.partitionBy(*group)
    return scored.withColumn("rank", (F.row_number().over(w.orderBy(*order)) - 1) / F.greatest(F.lit(1), F.count(F.lit(1)).over(w) - 1))


def search_components(scores: DataFrame, group: str, choice: str, pair: str, skip: str, keys: list[str]) -> DataFrame:
    """Per choice: paired wins against the skip choice, rank by mean scores, and 0.6 / 0.4 of the two."""
    base = scores.where(F.col(choice) == skip).select(group, pair, F.struct(*keys).alias("baseline"))
    won = F.count(F.when(F.struct(*keys) > F.col("baseline"), 1))
    per = scores.join(base, [group, pair]).groupBy(group, choice).agg(won.alias("pair_wins"), F.count(F.lit(1)).alias("pairs"), *[F.avg(k).alias(f"mean_{k}") for k in keys])
    ranked = normalized_rank(per, [group], [*[f"mean_{k}" for k in keys], choice])
    return ranked.withColumn("search_score", 0.6 * F.col("pair_wins") / F.col("pairs") + 0.4 * F.col("rank"))


def tag_matches(candidates: DataFrame, pool: DataFrame, key: str, tags: str, pool_key: str, pool_tags: str) -> DataFrame:
    """Per candidate how many of the pool share a tag with it: by exploded tags, so no pair is formed twice or without a match."""
    c = candidates.select(key, F.explode(tags).alias("tag")).distinct()
    p = pool.select(pool_key, F.explode(pool_tags).alias("tag")).distinct()
    return c.join(p, "tag").select(key, pool_key).distinct().groupBy(key).agg(F.count(F.lit(1)).alias("matches"))


def provider_counts(items: DataFrame, group: str, tags: str, rules: dict[str, Column]) -> DataFrame:
    """Per group and tag its count, with further tags where a rule over the group's counts (column n, a map) holds."""
    per = items.select(group, F.explode(tags).alias("tag")).groupBy(group, "tag").agg(F.count(F.lit(1)).alias("n"))
    packed = per.groupBy(group).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("tag", "n")))).alias("n"))
    extra = packed.select(group, F.explode(F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]))).alias("tag"), F.lit(1).cast("bigint").alias("n"))
    return per.unionByName(extra).groupBy(group, "tag").agg(F.sum("n").alias("n"))


def protected_choice(scored: DataFrame, group: str, choice: str, utility: str, margin: Column) -> DataFrame:
    """The choice of highest utility, or the best protected one (margin not null) within its margin of it."""
    order = [F.desc(utility), F.col(choice)]
    w = W.partitionBy(group)
    d = scored.withColumn("margin", margin).withColumn("place", F.row_number().over(w.orderBy(*order))).withColumn("guard", F.row_number().over(w.orderBy(F.col("margin").isNull(), *order)))
    top = d.where("place = 1").select(group, F.col(choice).alias("top"), F.col(utility).alias("top_utility"))
    safe = d.where("guard = 1 and margin is not null").select(group, F.col(choice).alias("safe"), F.col(utility).alias("safe_utility"), "margin")
    both = top.join(safe, group, "left")
    near = F.coalesce(F.col("top_utility") - F.col("safe_utility") <= F.col("margin"), F.lit(False))
    return both.select(group, F.when(near, F.col("safe")).otherwise(F.col("top")).alias("selected"), (near & (F.col("safe") != F.col("top"))).alias("overridden"))


def opening_choice(distribution: DataFrame, group: str, choice: str, probability: str, attack: Column, multiplier: float, weights: dict[str, float]) -> DataFrame:
    """Per group the choice of highest blended score: probability, raised for attacks and divided by the highest, with further weighted columns."""
    d = distribution.withColumn("raised", F.col(probability) * F.when(attack, F.lit(multiplier)).otherwise(F.lit(1.0)))
    d = d.withColumn("history", F.col("raised") / F.max("raised").over(W.partitionBy(group)))
    score = weights["search"] * F.col("history")
    for name, weight in weights.items():
        if name != "search":
            score = score + weight * F.col(name)
    d = d.withColumn("score", score)
    w = W.partitionBy(group).orderBy(F.desc("score"), choice)
    return d.withColumn("place", F.row_number().over(w)).where("place = 1").select(group, choice, "history", "score")


def opening_weighted(distribution: DataFrame, group: str, choice: str, probability: str, attack: Column, multiplier: float) -> DataFrame:
    """Per group and choice its probability, raised for attacks, as score, and whether it is selected: the highest score, then the lowest name."""
    if multiplier <= 0:
        raise ValueError("the multiplier must be positive")
    d = distribution.withColumn("score", F.col(probability) * F.when(attack, F.lit(multiplier)).otherwise(F.lit(1.0)))
    place = F.row_number().over(W.partitionBy(group).orderBy(F.desc("score"), choice))
    return d.select(group, choice, F.round("score", 8).alias("score"), (place == 1).alias("selected"))


def search_classes(stats: DataFrame, classes: DataFrame, state: str, action: str, class_id: str) -> DataFrame:
    """Statistics of a search's root actions summed per class, with means, and whether the class is the suggested one.

    stats: state, action, visits, evaluation_sum, evaluation_square_sum, terminal_wins, terminal_losses,
    ending_hp_sum, victory_ending_hp_sum. classes: state, action, class_id. problem names a class that
    the search did not reach and an action without a class. Suggested is the highest win rate, then
    mean HP of victories, visits, mean evaluation, and the lowest id.
    """
    counts = ["visits", "evaluation_sum", "evaluation_square_sum", "terminal_wins", "terminal_losses", "ending_hp_sum", "victory_ending_hp_sum"]
    d = classes.select(state, action, class_id).join(stats.select(state, action, *counts), [state, action], "full")
    per = d.groupBy(state, class_id).agg(F.count("visits").alias("members"), *[F.sum(c).alias(c) for c in counts])
    ratio = lambda a, b: F.try_divide(F.col(a), F.col(b))
    per = per.withColumns({"mean_evaluation": ratio("evaluation_sum", "visits"), "win_rate": ratio("terminal_wins", "visits"), "ending_hp_mean": ratio("ending_hp_sum", "visits"), "victory_ending_hp_mean": ratio("victory_ending_hp_sum", "terminal_wins")})
    per = per.withColumn("problem", F.when(F.col(class_id).isNull(), "action without class").when(F.col("members") == 0, "class not reached"))
    falling = [F.desc(F.coalesce("win_rate", F.lit(-1.0))), F.desc(F.coalesce("victory_ending_hp_mean", F.lit(-1.0))), F.desc("visits"), F.col("mean_evaluation").desc_nulls_last(), F.col(class_id)]
    place = F.row_number().over(W.partitionBy(state).orderBy(F.col("problem").isNotNull(), *falling))
    return per.withColumn("suggested", (place == 1) & F.col("problem").isNull())


def pivot_rates(long: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """One row per key with a column per metric, and the least of their sample sizes."""
    aggs = [F.max(F.when(F.col("metric") == m, F.col("rate"))).alias(m) for m in metrics]
    return long.where(F.col("metric").isin(metrics)).groupBy(*keys).agg(*aggs, F.min("sample_size").alias("sample_size"))
