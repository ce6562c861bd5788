"""Set and multiset operations on tables and arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def symmetric_difference(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_union(F.array_except(a, b), F.array_except(b, a)))


def is_subset(a: Column, b: Column) -> Column:
    return F.size(F.array_except(a, b)) == 0


def bag_difference(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with how much more often left has them: counted on both sides, so neither is replicated."""
    a = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("a"))
    b = right.groupBy(*keys).agg(F.count(F.lit(1)).alias("b"))
    d = a.join(b, keys, "left").withColumn("n", F.col("a") - F.coalesce("b", F.lit(0)))
    return d.where("n > 0").select(*keys, "n")


def bag_intersection(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    a = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("a"))
    b = right.groupBy(*keys).agg(F.count(F.lit(1)).alias("b"))
    return a.join(b, keys).select(*keys, F.least("a", "b").alias("n"))


def union_of_tags(rows: DataFrame, group: str, tags: str) -> DataFrame:
    """Per group the distinct tags of its rows, sorted."""
    return rows.select(group, F.explode(tags).alias("tag")).distinct().groupBy(group).agg(F.array_join(F.array_sort(F.collect_list("tag")), ",").alias("tags"))
