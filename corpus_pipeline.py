"""The corpus pipeline: quality rules, near-dedup, secret scan, source mixing, token ids.

Each stage takes what the one before kept and returns the columns of documents; the last
returns doc_id, source and the token ids. A row's fate depends on its own id, text, language and
source, so rows of one id are told apart. Keys of rows that go are broadcast where they are few
and joined otherwise, so the texts that stay are not shuffled for them. Every stage handles null,
empty and repeated rows as its operator does, and further columns whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from decispark.llm import bpe, mixing, neardup, quality, secrets
from decispark.llm.common import table
from decispark.sources.shared import cut, remove, remove_at_end, shared_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: At most so many ids are broadcast.
BROADCAST_IDS = 500_000
#: Shorter texts go; clean ones of fewer than ten words stay.
LEAST_WORDS = 3
RANKS = "byte_bpe_multi_50k.tiktoken"


#: Tells rows of one id apart.
KEY = "__row_key"


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn(KEY, F.xxhash64("text", "lang", "source"))


def _joined(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """Rows of docs (with KEY) that are (left_semi) or are not (left_anti) among the written keys; null ids match."""
    keys = keys.select(F.col("doc_id").alias("__id"), F.col(KEY).alias("__key"))
    few = F.broadcast(keys) if keys.count() <= BROADCAST_IDS else keys
    return docs.join(few, docs["doc_id"].eqNullSafe(few["__id"]) & (docs[KEY] == few["__key"]), how)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    keyed = _keyed(docs)
    gone = cut(quality.quality_rules(keyed, carry=(KEY,), least_words=LEAST_WORDS).where("not kept").select("doc_id", KEY).distinct(), "gone")
    return _joined(keyed, gone, "left_anti").select(docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates at a similarity of 0.8, of least id; a row that repeats it goes too."""
    keyed = _keyed(docs)
    found = neardup.near_duplicates(keyed, percent=80, carry=(KEY,))
    verdicts = cut(found.groupBy("doc_id", KEY).agg(F.every("representative").alias("stays"), F.count(F.lit(1)).alias("n")), "verdicts")
    left = _joined(keyed, verdicts.where("not stays"), "left_anti")
    twice = verdicts.where("stays and n > 1 and doc_id is not null")
    if twice.isEmpty():
        return left.select(docs.columns)
    once = _joined(left, twice, "left_anti")
    return once.unionByName(_joined(left, twice, "left_semi").dropDuplicates(["doc_id", KEY])).select(docs.columns)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by a mark and n_chars counted anew."""
    clean = secrets.redact(docs)
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars"))).select(docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    mixed = mixing.mix(docs.select("doc_id", "text", "source", F.struct(*docs.columns).alias("document"))).where("copies > 0")
    return mixed.select("document", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select("document.*")


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens and ids of every document."""
    ids = bpe.encode(docs.select("doc_id", "source", "text"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)
    return ids.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("secrets", secrets_stage),
    ("mixing", mixing_stage),
    ("byte_bpe", token_stage),
]

#: No SQL: robust estimates, Markov models and byte pair merges are beyond it; tests/llm has a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written to the shared folder and read again; a stage's table goes once the next one is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = shared_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    remove_at_end(spark, path)
    return docs
