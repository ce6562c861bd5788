"""Target-distribution importance resampling by hashed features and noisy scores (op12).

Features are runs of consecutive words, hashed into buckets. The bucket counts of all documents and
of the target give an array with one gain per bucket; a document's weight is the sum of the gains
of its features. Noise from the id's hash added to the weight makes the highest scores a draw without
replacement in proportion to exp(weight). The draw is made by an exact histogram of integer
scores: suffix sums of its counts say how many rows score higher, which gives the cutoff and each
score's first rank, so that rows are only numbered by id within one score. Nothing is sorted whole.

Scores are dealt to ranges of about equally many distinct scores; sums over ranges are at most
RANGES numbers, and windows stay inside a range or inside a score. The noise spreads rows of equal
weight: no score holds more than 0.04% of rows with different ids.

Edge cases: a null text has no words, weight 0 and is never drawn unless least_words is 0; a null
id hashes as 'null' and ranks last among ties; rows of one id and score rank in any order; an empty
table gives an empty result; an empty target gives the gains of zero counts; further columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Tables, plain_words, range_of, range_starts, small_batches

#: Hash buckets; the longest run of words that is a feature; the scale of gains and noise.
BUCKETS, LONGEST, SCALE = 10_000, 1, 1000
#: Distinct scores in a range, and the most ranges.
RANGE_SCORES, RANGES = 65_536, 4_096
#: Features whose gain a worker remembers.
REMEMBERED = 500_000


def features(raw: bytes | None, longest: int) -> tuple[int, list[bytes]]:
    """The number of words of a text, and its runs of 1 to longest words."""
    words = plain_words(raw) if raw else []
    runs = [b" ".join(words[i : i + k]) for k in range(2, longest + 1) for i in range(len(words) - k + 1)]
    return len(words), words + runs


def bucket_counts(docs: DataFrame, text: str = "text", buckets: int = BUCKETS, longest: int = LONGEST) -> list[int]:
    """Features of all texts by bucket. Each task sums its own, so at most buckets rows a task are shuffled, and buckets numbers reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, np.int64)
        for batch in batches:
            seen = Counter(chain.from_iterable(features(t, longest)[1] for t in batch.column(0).cast(pa.binary()).to_pylist()))
            np.add.at(sums, np.fromiter((zlib.crc32(f) % buckets for f in seen), np.int64, len(seen)), np.fromiter(seen.values(), np.int64, len(seen)))
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(sums[at])], names=["bucket", "n"])

    counts = small_batches(docs).select(F.col(text).cast("string")).mapInArrow(run, "bucket int, n long")
    out = [0] * buckets
    for r in counts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(own: list[int], target: list[int], scale: int = SCALE) -> np.ndarray:
    """floor(scale * ln) of the ratio of both smoothed shares, per bucket."""
    total, wanted, m = sum(own), sum(target), len(own)
    return np.array([math.floor(scale * math.log((t + 1) * (total + m) / ((s + 1) * (wanted + m)))) for s, t in zip(own, target, strict=True)], np.int64)


class Remembered(dict):
    """The gain of each feature; up to REMEMBERED of them are kept."""

    def __init__(self, by_bucket: np.ndarray) -> None:
        self.by_bucket = by_bucket.tolist()

    def __missing__(self, feature: bytes) -> int:
        gain = self.by_bucket[zlib.crc32(feature) % len(self.by_bucket)]
        if len(self) < REMEMBERED:
            self[feature] = gain
        return gain


def weighed(docs: DataFrame, by_bucket: np.ndarray, text: str = "text", longest: int = LONGEST) -> DataFrame:
    """docs without its text column, with n_words, n_features and weight."""
    own = ("n_words", "n_features", "weight")
    rest = [c for c in docs.columns if c != text and c not in own]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = Remembered(by_bucket).__getitem__
        for batch in batches:
            found = [features(t, longest) for t in batch.column(0).cast(pa.binary()).to_pylist()]
            values = [[n for n, _ in found], [len(f) for _, f in found], [sum(map(gain, f)) for _, f in found]]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *[pa.array(v, pa.int64()) for v in values]], names=[*rest, *own])

    schema = T.StructType([*[docs.schema[c] for c in rest], *[T.StructField(c, T.LongType()) for c in own]])
    return small_batches(docs).select(F.col(text).cast("string").alias(text), *rest).mapInArrow(run, schema)


def noise(key: Column, seed: int, scale: int = SCALE) -> Column:
    """floor of a Gumbel draw in units of 1/scale, from the hash of seed and key."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))), 256)
    u = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") + 0.5) / 4294967296.0
    return F.floor(-scale * F.log(-F.log(u))).cast("long")


def ranked(scored: DataFrame, score: str, key: str, enters: Column, numerator: int, denominator: int, tables: Tables) -> DataFrame:
    """scored with rank: 1, 2, ... for the floor(numerator * N / denominator) highest scores of the N rows that enter, ties to the smaller key; else null.

    scored must be a written table, as it is read several times.
    """
    entered = scored.where(enters)
    histogram = tables.cut(entered.groupBy(score).agg(F.count(F.lit(1)).alias("n")), "histogram")
    draw = numerator * (histogram.agg(F.sum("n")).first()[0] or 0) // denominator
    unranked = F.lit(None).cast("long").alias("rank")
    if draw <= 0:
        return scored.select("*", unranked)
    starts, _ = range_starts(histogram, score, RANGE_SCORES, RANGES)
    ranges = histogram.withColumn("range", range_of(F.col(score), starts))
    sums = {r["range"]: r["n"] for r in ranges.groupBy("range").agg(F.sum("n").alias("n")).collect()}
    higher, above = 0, {}
    for k in sorted(sums, reverse=True):
        above[k] = higher
        higher += sums[k]
    low = min(k for k, n in above.items() if n < draw)
    first = F.get(F.array(*[F.lit(above.get(k, 0)).cast("long") for k in range(low, len(starts))]), F.col("range") - low)
    inside = F.coalesce(F.sum("n").over(W.partitionBy("range").orderBy(F.desc(score)).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = tables.cut(ranges.where(F.col("range") >= low).withColumn("before", first + inside).where(F.col("before") < draw).select(F.col(score).alias("__score"), "before"), "offsets")
    cutoff = offsets.agg(F.min("__score")).first()[0]
    drawn = F.coalesce(enters & (F.col(score) >= cutoff), F.lit(False))
    few = F.broadcast(offsets) if offsets.count() <= 100_000 else offsets
    place = F.col("before") + F.row_number().over(W.partitionBy(score).orderBy(F.col(key).asc_nulls_last()))
    top = scored.where(drawn).join(few, F.col(score) == F.col("__score")).withColumn("rank", place)
    return top.select(*scored.columns, F.when(F.col("rank") <= draw, F.col("rank")).cast("long").alias("rank")).unionByName(scored.where(~drawn).select("*", unranked))


def resample(docs: DataFrame, target: DataFrame, share: tuple[int, int] = (10, 100), seed: int = 2024, least_words: int = 20, buckets: int = BUCKETS, longest: int = LONGEST, text: str = "text", target_text: str = "text", key: str = "doc_id", carry: tuple[str, ...] = ()) -> DataFrame:
    """key, the carried columns, n_words, n_features, weight, score and rank (null: not drawn) of every row of docs.

    share is a fraction (numerator, denominator) of the rows with at least least_words words.
    """
    tables = Tables(docs.sparkSession, "importance")
    by_bucket = gains(bucket_counts(docs, text, buckets, longest), bucket_counts(target, target_text, buckets, longest))
    weights = weighed(docs.select(key, *carry, text), by_bucket, text, longest)
    scored = tables.cut(weights.withColumn("score", F.col("weight") + noise(F.col(key), seed)), "scored")
    return ranked(scored, "score", key, F.col("n_words") >= least_words, *share, tables)
