"""Mixing of sources to target weights by hash-threshold histograms (op2).

A source's target exceeds its size by a ratio r of at most ``most``. Every document is taken
floor(r) times; the rest of the budget goes to documents whose hash lies below a threshold.
The threshold comes from sizes summed by source and hash bucket: the bucket in which the
budget ends is refined by its own hashes, twice; all others are never looked at again. Documents
that still fit into what is left are taken by a second and third, nested threshold of the
same kind. Nothing is sorted but one row per source and bucket; reruns agree, for the hash
depends on the id alone.

Edge cases: a null text has size 0; a null source is a source of its own, after the others;
repeated ids share a hash and are taken together; sources without words get no words; an
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Tables, text_of, words_of

#: Hash bits, and how many of them each histogram tells apart within the boundary bucket of the one before.
HASH_BITS, LEVELS = 48, (8, 10, 30)


def hash_of(key: Column) -> Column:
    """48 bits of the id's SHA-256 as a bigint; of 'null' without an id."""
    return F.conv(F.substring(F.sha2(F.coalesce(key.cast("string"), F.lit("null")), 256), 1, HASH_BITS // 4), 16, 10).cast("bigint")


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size in words and hash."""
    return docs.select("doc_id", "source", F.size(words_of(text_of())).cast("long").alias("size"), hash_of(F.col("doc_id")).alias("h"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """source, source_size and target: shares of all sizes by weight, none above most times its size.

    Weight by weight the level rises evenly until a source is full; sorted by the level at which
    each is full, the final level follows from running sums. One row per source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (place % len(weights) + 1).cast("int")).cast("double"))
    per = per.withColumn("cap", (most * F.col("source_size")).cast("double")).withColumn("total", F.sum("source_size").over(everything).cast("double"))
    order = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(W.unboundedPreceding, -1)
    per = per.withColumn("full", F.coalesce(F.sum("cap").over(before), F.lit(0.0))).withColumn("open", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    level = (F.col("total") - F.col("full")) / F.col("open")
    per = per.withColumn("level", F.max(F.when(F.col("cap") > F.col("weight") * level, level)).over(everything))
    target = F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("weight") * F.col("level")))
    return per.select("source", "source_size", target.alias("target"))


def _threshold(rows: DataFrame, budgets: DataFrame, tables: Tables) -> DataFrame:
    """k, cut_h, taken_sum: the largest hash up to which the sizes of rows fit into the budget; no row where none fits.

    Each histogram has at most 256 buckets a source, 1,024 in its boundary bucket, and then single
    hashes, so no source's sums grow with its documents. Only boundary buckets are read again.
    """
    shift = HASH_BITS
    state = budgets.select("k", "budget", F.lit(0).cast("bigint").alias("taken_sum"), F.lit(-1).cast("bigint").alias("cut_h"))
    upto = F.col("taken_sum") + F.sum("size").over(W.partitionBy("k").orderBy("bucket").rowsBetween(W.unboundedPreceding, 0))
    for bits in LEVELS:
        shift -= bits
        sums = rows.groupBy("k", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("size")).join(state, "k").withColumn("upto", upto)
        fits = F.col("upto") <= F.col("budget")
        found = sums.groupBy("k").agg(F.max(F.when(fits, F.col("bucket"))).alias("last"), F.max(F.when(fits, F.col("upto"))).alias("upto"), F.min(F.when(~fits, F.col("bucket"))).alias("edge"))
        last = F.shiftleft(F.col("last") + 1, shift) - 1
        state = tables.cut(state.join(found, "k", "left").select("k", "budget", F.coalesce("upto", "taken_sum").alias("taken_sum"), F.coalesce(last, "cut_h").alias("cut_h"), "edge"), "state")
        if shift:
            edges = state.where("edge is not null").select("k", "edge")
            rows = rows.join(edges, "k").where(F.shiftright("h", shift) == F.col("edge")).select("k", "h", "size")
            if bits == LEVELS[0]:
                rows = tables.cut(rows, "boundary")
        state = state.drop("edge")
    return state.where("cut_h >= 0").select("k", "cut_h", "taken_sum")


def plan_mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, passes: int = 3) -> DataFrame:
    """One row per source: k (its key), source_size, target, whole, and the nested thresholds (cuts with the sizes that fits admits)."""
    tables = Tables(docs.sparkSession, "mixing")
    items = tables.cut(sized(docs), "sizes")
    rows = items.withColumn("k", source_key())
    targets = source_targets(items, weights, most).withColumn("k", source_key())
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    budget = F.floor(F.col("target") - F.col("whole") * F.col("source_size")).cast("bigint")
    none = F.array().cast("array<bigint>")
    plan = tables.cut(targets.withColumn("whole", whole).withColumn("rest", budget).select("k", "source_size", "target", "whole", "rest", none.alias("cuts"), none.alias("fits")), "plan")
    for _ in range(passes):
        left = rows.join(plan.select("k", "rest", "cuts", "fits"), "k").where(~passed() & (F.col("size") <= F.col("rest"))).select("k", "h", "size")
        found = _threshold(left, plan.select("k", F.col("rest").alias("budget")), tables)
        d = plan.join(found, "k", "left")
        plan = tables.cut(d.select("k", "source_size", "target", "whole", (F.col("rest") - F.coalesce("taken_sum", F.lit(0))).alias("rest"), F.array_append("cuts", F.coalesce("cut_h", F.lit(-1).cast("bigint"))).alias("cuts"), F.array_append("fits", F.col("rest")).alias("fits")), "plan")
    tables.drop("sizes", "state", "boundary")
    return plan.drop("rest")


def source_key() -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null"))


def passed() -> Column:
    """Whether one of the thresholds takes a row once more: its hash is low enough and it was small enough to fit."""
    return F.exists(F.arrays_zip("cuts", "fits"), lambda x: (F.col("h") <= x["cuts"]) & (F.col("size") <= x["fits"]))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, passes: int = 3, sources_broadcast: int = 10_000) -> DataFrame:
    """The columns of docs with size, source_size, target and copies, the times that the mix takes the document.

    The plan has one row per source and is broadcast up to sources_broadcast of them, so docs are
    filtered where they are read; beyond, they are joined by source.
    """
    plan = plan_mix(docs, weights, most, passes)
    own = [c for c in docs.columns if c not in ("size", "source_size", "target", "copies")]
    rows = docs.select(F.struct(*own).alias("row"), F.size(words_of(text_of())).cast("long").alias("size"), hash_of(F.col("doc_id")).alias("h"), source_key().alias("k"))
    d = rows.join(F.broadcast(plan) if plan.count() <= sources_broadcast else plan, "k")
    return d.select("row.*", "size", "source_size", "target", F.least(F.col("whole") + passed().cast("long"), F.lit(most)).cast("long").alias("copies"))
