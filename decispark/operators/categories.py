"""Tagged items of states: state-equal shares, retention, quality counters, reports by family."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def state_equal_shares(items: DataFrame, state: str, tags: Column) -> DataFrame:
    """Per tag its share where every state counts one, split evenly over its items; an item counts for each of its tags."""
    per = items.groupBy(state).agg(F.count(F.lit(1)).alias("n_items"))
    states = per.agg(F.count(F.lit(1)).alias("n_states"))
    tagged = items.select(state, F.explode(tags).alias("tag")).groupBy(state, "tag").agg(F.count(F.lit(1)).alias("n"))
    d = tagged.join(per, state).groupBy("tag").agg(F.sum(F.col("n") / F.col("n_items")).alias("mass"), F.sum("n").alias("items"))
    return d.join(F.broadcast(states)).select("tag", (F.col("mass") / F.col("n_states")).alias("share"), "items")


def retention(items: DataFrame, state: str, tags: Column, kept: Column) -> DataFrame:
    """Per tag: states that offer it, states that keep one, rate, and the mean share kept within a state."""
    d = items.select(state, F.explode(tags).alias("tag"), kept.cast("int").alias("kept")).groupBy(state, "tag").agg(F.count(F.lit(1)).alias("offered"), F.sum("kept").alias("kept"))
    d = d.groupBy("tag").agg(F.count(F.lit(1)).alias("opportunity_states"), F.count(F.when(F.col("kept") > 0, 1)).alias("retained_states"), F.avg(F.col("kept") / F.col("offered")).alias("mean_retention"))
    return d.withColumn("retained_rate", F.col("retained_states") / F.col("opportunity_states"))


def quality_counts(states: DataFrame, conditions: dict[str, Column], family: str | None = None) -> DataFrame:
    """How many states meet each condition, overall and, with family, by family (null: overall)."""
    aggs = [F.count(F.lit(1)).alias("states"), *[F.count(F.when(c, 1)).alias(n) for n, c in conditions.items()]]
    if family is None:
        return states.agg(*aggs)
    d = states.withColumn("view", F.explode(F.array(F.lit("all"), F.lit("family"))))
    return d.groupBy("view", F.when(F.col("view") == "family", F.col(family)).alias("family")).agg(*aggs)


def last_of_each(items: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row per key: the last by order."""
    rest = [c for c in items.columns if c not in key]
    return items.groupBy(*key).agg(F.max(F.struct(*order, F.struct(*rest).alias("row"))).alias("x")).select(*key, "x.row.*")


def tally(items: DataFrame, group: list[str], of: Column, name: str = "value") -> DataFrame:
    return items.groupBy(*group, of.alias(name)).agg(F.count(F.lit(1)).alias("n"))


def rendered_counts(items: DataFrame, group: list[str], of: Column) -> DataFrame:
    """Per group the multiset of a column as text, e.g. a x2, b x1."""
    d = tally(items, group, of)
    line = F.concat("value", F.lit(" x"), F.col("n").cast("string"))
    return d.groupBy(*group).agg(F.array_join(F.array_sort(F.collect_list(line)), ", ").alias("counts"))


def ratio_of_sums(rows: DataFrame, by: list[str], ratios: dict[str, tuple[str, str]]) -> DataFrame:
    """Per group sums and their ratios, never means of ratios; null where the denominator is zero."""
    names = sorted({c for pair in ratios.values() for c in pair})
    d = rows.groupBy(*by).agg(*[F.sum(c).alias(f"sum_{c}") for c in names])
    return d.select("*", *[F.expr(f"try_divide(sum_{a}, sum_{b})").alias(n) for n, (a, b) in ratios.items()])
