"""Assertions as queries: every function returns the rows that break a rule, with the rule's name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def broken(rows: DataFrame, keys: list[str], rules: dict[str, Column]) -> DataFrame:
    """keys and rule for every row and rule that does not hold (null counts as broken). One scan for all rules."""
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()]))
    return rows.select(*keys, F.explode(failed).alias("rule"))


def broken_counts(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Per rule how many rows break it."""
    return rows.agg(*[F.count(F.when(~F.coalesce(rule, F.lit(False)), 1)).alias(name) for name, rule in rules.items()])


def action_lines(text: Column, n: Column) -> Column:
    """Whether the lines ACTION_<i>: of a text are exactly 0 to n - 1, in order."""
    found = F.regexp_extract_all(text, F.lit("(?m)^ACTION_([0-9]+):"), F.lit(1))
    wanted = F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: i.cast("string"))).otherwise(F.array().cast("array<string>"))
    return found == wanted


def edge_rules(edges: str, legal: str) -> dict[str, Column]:
    """Rules of an array of preference edges (chosen, rejected, weight) against the legal actions."""
    e = F.col(edges)
    total = F.aggregate(e, F.lit(0.0), lambda s, x: s + x["weight"])
    return {
        "known": F.forall(e, lambda x: F.array_contains(legal, x["chosen"]) & F.array_contains(legal, x["rejected"])),
        "distinct_sides": F.forall(e, lambda x: x["chosen"] != x["rejected"]),
        "unique": F.size(F.array_distinct(F.transform(e, lambda x: F.struct(x["chosen"], x["rejected"])))) == F.size(e),
        "positive": F.forall(e, lambda x: (x["weight"] > 0) & (x["weight"] < float("inf"))),
        "sum_one": F.abs(total - 1) < 1e-9,
    }


def mean_one(rows: DataFrame, weight: str, by: list[str], tolerance: float = 1e-6) -> DataFrame:
    """Groups whose weights are mixed with nulls or do not have a mean of one."""
    d = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), F.count(weight).alias("weighted"), F.avg(weight).alias("mean"))
    return d.where((F.col("weighted") > 0) & ((F.col("weighted") < F.col("rows")) | (F.abs(F.col("mean") - 1) > tolerance)))


def mass_shares(rows: DataFrame, source: str, weight: str) -> DataFrame:
    """Per source the share of the total weight: to be held against the declared masses."""
    per = rows.groupBy(source).agg(F.sum(weight).alias("w"))
    total = per.agg(F.sum("w").alias("total"))
    return per.join(F.broadcast(total)).select(source, (F.col("w") / F.col("total")).alias("share"))


def mixture_masses(masses: DataFrame, mixture: str, mass: str, tolerance: float = 1e-12) -> DataFrame:
    """mixture and rule where declared masses are not all positive and finite, or do not sum to one."""
    fine = F.coalesce((F.col(mass) > 0) & (F.col(mass) < float("inf")), F.lit(False))
    per = masses.groupBy(mixture).agg(F.every(fine).alias("fine"), F.sum(mass).alias("total"))
    return broken(per, [mixture], {"positive": F.col("fine"), "sum_one": F.abs(F.col("total") - 1) <= tolerance})


def pair_completeness(pairs: DataFrame, group: str, a: str, b: str, n_items: str) -> DataFrame:
    """Groups whose unordered pairs are not each of n (n - 1) / 2 once."""
    d = pairs.groupBy(group).agg(F.count(F.lit(1)).alias("pairs"), F.countDistinct(F.least(a, b), F.greatest(a, b)).alias("distinct_pairs"), F.max(n_items).alias("n"))
    return d.where("distinct_pairs <> n * (n - 1) / 2 or pairs <> distinct_pairs")


def expected_observed(rows: DataFrame, keys: list[str], checks: dict[str, tuple[str, str]]) -> DataFrame:
    """field, expected, observed for every field whose two columns differ, as text."""
    items = F.array(*[F.struct(F.lit(n).alias("field"), F.col(e).cast("string").alias("expected"), F.col(o).cast("string").alias("observed")) for n, (e, o) in checks.items()])
    return rows.select(*keys, F.explode(F.filter(items, lambda x: ~x["expected"].eqNullSafe(x["observed"]))).alias("x")).select(*keys, "x.*")


def same_digest(rows: DataFrame, key: str, digest: str) -> DataFrame:
    """Keys whose references resolve to more than one digest."""
    return rows.groupBy(key).agg(F.countDistinct(digest).alias("digests")).where("digests > 1")


def gates(rows: DataFrame, scope: str, matched: Column, name: str) -> DataFrame:
    """Per scope: compared, matched, whether all match, and the names that do not."""
    miss = F.array_join(F.array_sort(F.collect_set(F.when(~matched, F.col(name).cast("string")))), ",")
    return rows.groupBy(scope).agg(F.count(F.lit(1)).alias("compared"), F.count(F.when(matched, 1)).alias("matched"), F.every(matched).alias("all_match"), miss.alias("missing"))
