"""Nested values against each other: canonical projections, recursive differences, replayed episodes."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from decispark.sources.shared import cut

#: Stands for a value that one side lacks.
ABSENT = "<absent>"
NUMBERS = r"^(BIGINT|DECIMAL.*|DOUBLE|FLOAT)$"


# canonical projections


@dataclass(frozen=True)
class Ordered:
    """An array whose order counts."""

    of: Any = None


@dataclass(frozen=True)
class Bag:
    """An array whose order does not count, though its multiplicities do; null elements are dropped."""

    of: Any = None


@dataclass(frozen=True)
class Default:
    """A value that stands for null."""

    value: Any


def projection(value: Column, spec: Any) -> Column:
    """The public part of a nested value in a form that is equal for equal meaning.

    spec: None takes the value as it is, Default fills null, a dict takes those fields of a struct (null
    stays null), Ordered and Bag project the elements of an array; a bag is sorted by the digests of its
    elements, so that permutations become the same array.
    """
    if spec is None:
        return value
    if isinstance(spec, Default):
        return F.coalesce(value, F.lit(spec.value))
    if isinstance(spec, dict):
        return F.when(value.isNotNull(), F.struct(*[projection(value[k], s).alias(k) for k, s in spec.items()]))
    if isinstance(spec, Ordered):
        return F.transform(value, lambda x: projection(x, spec.of))
    keyed = F.transform(F.array_compact(value), lambda x: F.struct(element_digest(projection(x, spec.of)).alias("digest"), projection(x, spec.of).alias("item")))
    return F.transform(F.array_sort(keyed), lambda x: x["item"])


def element_digest(value: Column) -> Column:
    """SHA-256 of a value as JSON, nulls written."""
    return F.sha2(F.to_json(F.struct(value.alias("v")), {"ignoreNullFields": "false"}), 256)


def projection_digest(value: Column, spec: Any) -> Column:
    """SHA-256 of the projection: two states mean the same if these are equal."""
    return F.sha2(F.to_json(projection(value, spec), {"ignoreNullFields": "false"}), 256)


# recursive differences


def _kind(v: Column) -> Column:
    return F.coalesce(F.substring_index(F.schema_of_variant(v), "<", 1), F.lit("VOID"))


def _same_leaf(e: Column, a: Column) -> Column:
    """Equal as text, or equal numbers of whatever type."""
    as_ = lambda v, t: F.try_variant_get(v, "$", t)
    exact = as_(e, "decimal(38,10)").eqNullSafe(as_(a, "decimal(38,10)"))
    numbers = F.col("e_kind").rlike(NUMBERS) & F.col("a_kind").rlike(NUMBERS)
    return F.to_json(e).eqNullSafe(F.to_json(a)) | F.coalesce(numbers & exact & (as_(e, "double") == as_(a, "double")), F.lit(False))


def _level(pairs: DataFrame) -> DataFrame:
    """Pairs (id, path, e, a, e_there, a_there) that differ, with the kinds of both sides."""
    return pairs.where("e_there <> a_there or not (to_json(e) <=> to_json(a))").withColumns({"e_kind": _kind(F.col("e")), "a_kind": _kind(F.col("a"))})


def _both(kind: str) -> Column:
    return F.col("e_there") & F.col("a_there") & (F.col("e_kind") == kind) & (F.col("a_kind") == kind)


def _fields(level: DataFrame) -> DataFrame:
    """Pairs of values under each key of two objects, whichever has it."""
    side = lambda c: F.try_variant_get(c, "$", "map<string,variant>")
    d = level.where(_both("OBJECT")).select("id", "path", side("e").alias("em"), side("a").alias("am"))
    d = d.select("id", "path", "em", "am", F.explode(F.array_union(F.map_keys("em"), F.map_keys("am"))).alias("k"))
    return d.select(
        "id", F.concat("path", F.lit("."), "k").alias("path"), F.try_element_at("em", F.col("k")).alias("e"), F.try_element_at("am", F.col("k")).alias("a"),
        F.map_contains_key("em", F.col("k")).alias("e_there"), F.map_contains_key("am", F.col("k")).alias("a_there"),
    )


def _elements(level: DataFrame) -> DataFrame:
    """Pairs of values at each place that two arrays share."""
    side = lambda c: F.try_variant_get(c, "$", "array<variant>").alias(c)
    d = level.where(_both("ARRAY")).select("id", "path", side("e"), side("a"))
    d = d.select("id", "path", F.posexplode(F.slice(F.arrays_zip("e", "a"), F.lit(1), F.least(F.size("e"), F.size("a")))).alias("i", "x"))
    return d.select("id", F.format_string("%s[%d]", "path", "i").alias("path"), "x.e", "x.a", F.lit(True).alias("e_there"), F.lit(True).alias("a_there"))


def _found(level: DataFrame) -> DataFrame:
    """The differences that a level settles: leaves, values of two kinds, absent values, lengths."""
    side = lambda there, v: F.when(F.col(there), F.coalesce(F.to_json(v), F.lit("null"))).otherwise(ABSENT)
    equal = F.coalesce(F.col("e_there") & F.col("a_there") & _same_leaf(F.col("e"), F.col("a")), F.lit(False))
    both = lambda kind: F.coalesce(_both(kind), F.lit(False))
    own = level.where(~both("OBJECT") & ~both("ARRAY") & ~equal)
    length = lambda v: F.size(F.try_variant_get(v, "$", "array<variant>")).cast("string")
    lengths = level.where(both("ARRAY")).select("id", "path", length("e").alias("expected"), length("a").alias("observed")).where("expected <> observed")
    return own.select("id", "path", side("e_there", "e").alias("expected"), side("a_there", "a").alias("observed")).unionByName(lengths.withColumn("path", F.concat("path", F.lit(".length"))))


def nested_differences(expected: DataFrame, observed: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, path, expected and observed where two JSON documents (columns of text) of one key differ.

    Paths go down to the value that differs ($.a.b[2]); arrays of unequal length give their length, and
    are compared as far as both go; a value that one side lacks is '<absent>', and so is all of a key
    that one side lacks; text that is null or no JSON counts as null; 1 and 1.0 are equal. Keys are distinct;
    null ones are equal.

    The sides meet once, by key. Then each level is a narrow step from the one before: only pairs whose
    canonical texts differ go further down, until no container is left. Equal documents cost one comparison.
    """
    side = lambda d, name: d.select(F.struct(*keys).alias(f"{name}_id"), F.coalesce(F.try_parse_json(value), F.parse_json(F.lit("null"))).alias(name), F.lit(True).alias(f"{name}_there"))
    pairs = side(expected, "e").join(side(observed, "a"), F.col("e_id").eqNullSafe(F.col("a_id")), "full_outer")
    pairs = pairs.select(F.coalesce("e_id", "a_id").alias("id"), F.lit("$").alias("path"), "e", "a", *[F.coalesce(f"{n}_there", F.lit(False)).alias(f"{n}_there") for n in "ea"])
    out = None
    while True:
        level = cut(_level(pairs), "level")
        found = _found(level)
        out = found if out is None else out.unionByName(found)
        if level.where(_both("OBJECT") | _both("ARRAY")).isEmpty():
            return out.select("id.*", "path", "expected", "observed")
        pairs = _fields(level).unionByName(_elements(level))


# replayed episodes


def _step(name: str) -> Column:
    return F.coalesce(F.col(name).cast("long"), F.lit(-1))


def _blocks(steps: DataFrame, episode: str, step: str, columns: list[str], block: int) -> DataFrame:
    """One row for each block of steps: its digest by step order, and its rows."""
    digest = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    same = steps.select(F.col(episode).alias("episode"), _step(step).alias("step"), digest.alias("digest")).groupBy("episode", "step", "digest").agg(F.count(F.lit(1)).alias("n"))
    chain = F.aggregate(F.array_sort(F.collect_list(F.struct("step", "digest", "n"))), F.lit(""), lambda h, x: F.sha2(F.concat(h, F.to_json(x)), 256))
    return same.groupBy("episode", F.floor(F.col("step") / block).alias("block")).agg(chain.alias("chain"), F.sum("n").alias("n"))


def first_divergence(recorded: DataFrame, replayed: DataFrame, episode: str, step: str, columns: list[str], block: int = 256) -> DataFrame:
    """episode, verified, status, step, recorded and replayed: per episode how far a replay follows the record.

    Steps are chained by digest in blocks of bounded size, so an episode of any length meets in pieces
    and equal blocks cost one comparison; only the first block whose chains differ is read step by step.
    A null step counts as step -1. verified counts the recorded steps before the divergence. status: verified, diverges (another row),
    repeated (a step is there more than once on a side), not replayed, not recorded. recorded and replayed are
    the columns of the diverging step as JSON, null where a side has none.
    """
    own = [_blocks(d, episode, step, columns, block).withColumnRenamed("chain", c).withColumnRenamed("n", n) for d, c, n in ((recorded, "c1", "n1"), (replayed, "c2", "n2"))]
    met = cut(own[0].join(own[1], (own[0]["episode"].eqNullSafe(own[1]["episode"])) & (own[0]["block"].eqNullSafe(own[1]["block"])), "full_outer").select(F.coalesce(own[0]["episode"], own[1]["episode"]).alias("episode"), F.coalesce(own[0]["block"], own[1]["block"]).alias("block"), "c1", "c2", "n1"), "blocks")
    broken = F.min(F.when(~F.col("c1").eqNullSafe(F.col("c2")), F.col("block")))
    heads = met.groupBy("episode").agg(broken.alias("at"), F.sum("n1").alias("total"))
    before = met.join(heads.select(F.col("episode").alias("e2"), "at"), F.col("episode").eqNullSafe(F.col("e2"))).groupBy("episode").agg(F.first("at").alias("at"), F.coalesce(F.sum("n1"), F.lit(0)).alias("total"), F.coalesce(F.sum(F.when(F.col("block") < F.col("at"), F.col("n1"))), F.lit(0)).alias("before"))
    heads = cut(before, "heads")
    wanted = heads.where("at is not null").select(F.col("episode").alias("e2"), F.col("at"))

    def rows(d: DataFrame, name: str) -> DataFrame:
        d = d.select(F.col(episode).alias("episode"), _step(step).alias("step"), F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("row"))
        d = d.join(wanted, F.col("episode").eqNullSafe(F.col("e2")) & (F.floor(F.col("step") / block) == F.col("at")), "left_semi")
        return d.groupBy("episode", "step").agg(F.min("row").alias(name), F.count(F.lit(1)).alias(f"n_{name}"))

    a, b = rows(recorded, "recorded"), rows(replayed, "replayed")
    both = a.join(b, a["episode"].eqNullSafe(b["episode"]) & a["step"].eqNullSafe(b["step"]), "full_outer").select(F.coalesce(a["episode"], b["episode"]).alias("episode"), F.coalesce(a["step"], b["step"]).alias("step"), "recorded", "replayed", "n_recorded", "n_replayed")
    status = (
        F.when((F.col("n_recorded") > 1) | (F.col("n_replayed") > 1), "repeated")
        .when(F.col("replayed").isNull(), "not replayed").when(F.col("recorded").isNull(), "not recorded").when(F.col("recorded") != F.col("replayed"), "diverges")
    )
    order = W.partitionBy("episode").orderBy("step")
    # Both sides of the block are a bounded number of steps, so the window is too.
    both = both.withColumn("status", status).withColumn("followed", F.coalesce(F.sum("n_recorded").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    first = both.where("status is not null").withColumn("place", F.row_number().over(order)).where("place = 1").select(F.col("episode").alias("e2"), "status", "step", "recorded", "replayed", "followed")
    d = heads.join(first, F.col("episode").eqNullSafe(F.col("e2")), "left")
    verified = F.when(F.col("status").isNull(), F.col("total")).otherwise(F.col("before") + F.col("followed"))
    return d.select(F.col("episode").alias(episode), verified.cast("long").alias("verified"), F.coalesce("status", F.lit("verified")).alias("status"), F.col("step").alias(step), "recorded", "replayed")
