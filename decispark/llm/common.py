"""Helpers that the corpus operators share: words, shared tables, ranges of ids."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from decispark.sources.shared import cut, remove, shared_dir, shared_path  # noqa: F401

#: A word is a run of characters outside this class.
SPACES = r"[\x20\x09-\x0D]+"
#: Sorts before every other id; stands for a null id.
LOWEST = -(2**63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; one whose files give a few tasks only is dealt out to all cores, as work on texts outweighs moving them."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores, F.xxhash64(*df.columns)) if 4 * df.rdd.getNumPartitions() <= cores else df


class Tables:
    """Tables that an operator writes to the shared folder on its way, to be dropped after their last use.

    What a returned DataFrame still reads stays until the application ends.
    """

    def __init__(self, spark: SparkSession, tag: str) -> None:
        self.spark, self.folder, self.paths, self.n = spark, shared_path(spark, tag), defaultdict(list), 0

    def cut(self, df: DataFrame, name: str) -> DataFrame:
        """Write df and read it back: the lineage ends there and survives lost executors."""
        self.n += 1
        path = f"{self.folder}/{name}-{self.n}"
        self.paths[name].append(path)
        return cut(df, name, path)

    def drop(self, *names: str) -> None:
        for name in names:
            for path in self.paths.pop(name, []):
                remove(self.spark, path)


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: Rows and bytes in an Arrow batch of texts: what a Python worker and its executor hold at a time.
BATCH_ROWS, BATCH_BYTES = 1_000, 4_000_000


def small_batches(df: DataFrame) -> DataFrame:
    """df, after lowering the session's Arrow batches to BATCH_ROWS and BATCH_BYTES where they are larger.

    The defaults are made for narrow rows; texts would fill an executor's memory beside its heap.
    """
    conf = df.sparkSession.conf
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(conf.get(rows)) <= BATCH_ROWS:
        conf.set(rows, BATCH_ROWS)
    if not 0 < int(conf.get(size).rstrip("b")) <= BATCH_BYTES:
        conf.set(size, f"{BATCH_BYTES}b")
    return df


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    """The words of a text, in order; empty array without words."""
    return F.array_remove(F.split(text, SPACES, -1), "")


#: Lower-cases A-Z and makes a space of every ASCII character that is neither letter nor digit.
PLAIN = bytes(c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))


def plain_words(raw: bytes) -> list[bytes]:
    """Lower-cased words of letters, digits and characters beyond ASCII of a text in UTF-8."""
    return raw.translate(PLAIN).split()


def shingle_hashes(word_hashes: Column, n: int = 5) -> Column:
    """Hash of each run of n words; of the whole sequence where there are 1 to n - 1 words; empty without words."""
    size = F.size(word_hashes)
    runs = F.transform(
        F.slice(word_hashes, F.lit(1), F.greatest(size - (n - 1), F.lit(0))),
        lambda x, i: F.xxhash64(x, *[F.get(word_hashes, i + k) for k in range(1, n)]),
    )
    return F.when(size >= n, runs).when(size > 0, F.array(F.xxhash64(word_hashes))).otherwise(F.slice(word_hashes, 1, 0))


def range_starts(df: DataFrame, key: str, rows: int = 256, most: int = 65536) -> tuple[list[int], int | None]:
    """Ids that start ranges of about equally many rows, and the smallest id. At most `most` ids reach the driver."""
    k = F.coalesce(F.col(key), F.lit(LOWEST))
    n, low = df.agg(F.count(F.lit(1)), F.min(k)).first()
    parts = max(1, min(most, -(-n // rows)))
    if parts == 1:
        return ([] if low is None else [low]), low
    at = df.agg(F.percentile_approx(k, [i / parts for i in range(1, parts)], 20 * parts)).first()[0]
    return sorted({low, *at}), low


def range_of(key: Column, starts: list[int]) -> Column:
    """Index of the last start that is at most key, by two levels of at most 256 comparisons."""
    if len(starts) < 2:
        return F.lit(0)
    step = max(1, int(len(starts) ** 0.5))
    groups = [starts[i : i + step] for i in range(0, len(starts), step)]
    fine = F.array(*[F.array(*[F.lit(x) for x in g]) for g in groups]) if len(starts) <= 64 else F.from_json(F.lit(str(groups)), "array<array<bigint>>")
    coarse = F.array(*[F.lit(g[0]) for g in groups])
    below = lambda arr: F.size(F.filter(arr, lambda s: s <= key))
    first = F.greatest(below(coarse), F.lit(1)) - 1
    return first * step + F.greatest(below(F.get(fine, first)), F.lit(1)) - 1
