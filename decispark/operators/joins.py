"""Join-shaped operators: identity, overlap, isolation, crosswalk, panels, positions, diffs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def identity_join(rows: DataFrame, other: DataFrame, keys: list[str], same: dict[str, str]) -> DataFrame:
    """rows with status: matched, missing in other, or mismatch of a pair of columns."""
    o = other.select(*[F.col(k).alias(f"__{k}") for k in keys], *[F.col(c).alias(f"__o_{c}") for c in same.values()], F.lit(True).alias("__there"))
    on = [F.col(k) == F.col(f"__{k}") for k in keys]
    equal = F.lit(True)
    for a, b in same.items():
        equal = equal & F.col(a).eqNullSafe(F.col(f"__o_{b}"))
    status = F.when(F.col("__there").isNull(), "missing").when(equal, "matched").otherwise("mismatch")
    return rows.join(o, on, "left").select(*rows.columns, status.alias("status"))


def overlap(rows: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """rows with overlaps: whether their key is in other."""
    return rows.join(other.select(*keys).distinct().withColumn("__there", F.lit(True)), keys, "left").select(*rows.columns, F.col("__there").isNotNull().alias("overlaps"))


def leakage(train: DataFrame, test: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """Per named key the number of its values on both sides."""
    out = None
    for name, key in keys.items():
        both = train.select(key.alias("k")).distinct().join(test.select(key.alias("k")).distinct(), "k", "left_semi")
        row = both.agg(F.lit(name).alias("key"), F.count(F.lit(1)).alias("shared"))
        out = row if out is None else out.unionByName(row)
    return out


def in_intervals(rows: DataFrame, value: str, intervals: DataFrame, lo: str, hi: str, width: float) -> DataFrame:
    """Rows whose value lies in a closed interval, with it.

    Intervals are spread over cells of `width`, so rows meet only those of their own cell, by an equi-join.
    """
    cell = lambda c: F.floor(c / width).cast("bigint")
    spread = intervals.withColumn("__cell", F.explode(F.sequence(cell(F.col(lo)), cell(F.col(hi)))))
    return rows.withColumn("__cell", cell(F.col(value))).join(spread, "__cell").where(F.col(value).between(F.col(lo), F.col(hi))).drop("__cell")


def pair_lookup(rows: DataFrame, a: str, b: str, pairs: DataFrame, pa: str, pb: str, keys: list[str]) -> DataFrame:
    """rows joined to pairs by unordered pair and keys."""
    low, high = F.least(a, b), F.greatest(a, b)
    p = pairs.withColumn("__lo", F.least(pa, pb)).withColumn("__hi", F.greatest(pa, pb)).drop(pa, pb)
    return rows.withColumn("__lo", low).withColumn("__hi", high).join(p, [*keys, "__lo", "__hi"], "left").drop("__lo", "__hi")


def crosswalk(left: DataFrame, name: Column, right: DataFrame, right_name: Column, value: str) -> DataFrame:
    """Distinct names of left with key, the right value of equal key (null if not one), and status matched, ambiguous or missing."""
    l = left.select(name.alias("name")).distinct().withColumn("key", F.lower(F.regexp_replace("name", "[^A-Za-z0-9]", "")))  # noqa: E741
    r = right.select(F.lower(F.regexp_replace(right_name, "[^A-Za-z0-9]", "")).alias("key"), F.col(value).alias("value")).groupBy("key").agg(F.countDistinct("value").alias("n"), F.min("value").alias("value"))
    status = F.when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "ambiguous").otherwise("matched")
    return l.join(r, "key", "left").select("name", "key", F.when(F.col("n") == 1, F.col("value")).alias("value"), status.alias("status"))


def panel(spark, axes: dict[str, list], seed: int = 0) -> DataFrame:
    """Every combination of the axes with its index, in the order of the axes, from index arithmetic alone (no join)."""
    n = 1
    for values in axes.values():
        n *= len(values)
    d, span = spark.range(n).withColumnRenamed("id", "index"), n
    for name, values in axes.items():
        span //= len(values)
        d = d.withColumn(name, F.element_at(F.array(*[F.lit(v) for v in values]), (F.floor(F.col("index") / span) % len(values) + 1).cast("int")))
    return d.withColumn("seed", F.col("index") + F.lit(seed))


def zipped(left: DataFrame, right: DataFrame, keys: list[str], left_order: list[str], right_order: list[str]) -> DataFrame:
    """Rows of both sides by position within keys; with status where a side is longer."""
    place = lambda d, order: d.withColumn("position", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    a, b = place(left, left_order).withColumn("__a", F.lit(True)), place(right, right_order).withColumn("__b", F.lit(True))
    d = a.join(b, [*keys, "position"], "full_outer")
    return d.withColumn("status", F.when(F.col("__a").isNull(), "right only").when(F.col("__b").isNull(), "left only").otherwise("paired")).drop("__a", "__b")


def key_differences(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys on one side only, and which."""
    a, b = left.select(*keys).distinct().withColumn("__a", F.lit(True)), right.select(*keys).distinct().withColumn("__b", F.lit(True))
    return a.join(b, keys, "full_outer").where("__a is null or __b is null").select(*keys, F.when(F.col("__a").isNull(), "right only").otherwise("left only").alias("side"))


def picked(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """The wanted keys with how often rows has each: 1 is right, 0 missing, more ambiguous."""
    n = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return wanted.select(key).distinct().join(n, key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n"))


def row_differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows, with their number, that one side has more often: recomputed against reported."""
    side = lambda a, b, name: a.exceptAll(b).withColumn("side", F.lit(name))
    return side(left, right, "left only").unionByName(side(right, left, "right only"))


def flattened(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """key, path, value rows of a table, values as text."""
    return rows.select(*keys, *[F.col(c).cast("string").alias(c) for c in columns]).unpivot(keys, columns, "path", "value")


def structural_diff(expected: DataFrame, observed: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """key, path, expected, observed where the two differ, nulls included."""
    e = flattened(expected, keys, columns).withColumnRenamed("value", "expected")
    o = flattened(observed, keys, columns).withColumnRenamed("value", "observed")
    return e.join(o, [*keys, "path"], "full_outer").where(~F.col("expected").eqNullSafe(F.col("observed")))


def adjacent_difference(rows: DataFrame, group: str, order: list[str], items: str) -> DataFrame:
    """Each row's array of items less the one before as multisets: gained and lost, as sorted text."""
    before = F.coalesce(F.lag(items).over(W.partitionBy(group).orderBy(*order)), F.array().cast("array<string>"))
    d = rows.withColumn("__before", before)
    return d.withColumn("gained", bag_minus(F.col(items), F.col("__before"))).withColumn("lost", bag_minus(F.col("__before"), F.col(items))).drop("__before")


def bag_minus(a: Column, b: Column) -> Column:
    """Multiset difference of two arrays of text, as sorted text: each value as often as a has it more."""
    count = lambda arr, v: F.size(F.filter(arr, lambda x: x == v))
    extra = F.flatten(F.transform(F.array_sort(F.array_distinct(a)), lambda v: F.array_repeat(v, F.greatest(count(a, v) - count(b, v), F.lit(0)))))
    return F.array_join(extra, ",")


def chained(rows: DataFrame, hops: list[tuple[DataFrame, str, str, str]]) -> DataFrame:
    """rows through a chain of look-ups, each (table, key of what is there, key of the table, column to take); with the first hop that finds nothing.

    A table is looked up by its own distinct key; Spark broadcasts the small ones itself.
    """
    d = rows.withColumn("unmatched", F.lit(None).cast("string"))
    for table, key, table_key, take in hops:
        t = table.select(F.col(table_key).alias("__k"), F.col(take).alias(take), F.lit(True).alias("__there"))
        d = d.join(t, F.col(key) == F.col("__k"), "left")
        d = d.withColumn("unmatched", F.coalesce("unmatched", F.when(F.col("__there").isNull(), F.lit(take)))).drop("__k", "__there")
    return d
