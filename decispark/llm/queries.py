"""Queries opN_<name> of the corpus operators, and their SQL where SQL can express them.

Paths of vocabulary files come from the public_tokenizers package; they are parameters of the operators.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontamination, fingerprints, html, importance, licences, mixing, neardup, pii, quality, secrets, token_store, whitening
from .common import shared_path, table

RANKS, VOCABULARY = "byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.json"


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = fingerprints.edited(table(spark, sf_dir, "documents"))
    return d.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        fingerprints.hex_of(F.col("fingerprint")).alias("fingerprint"),
        fingerprints.hex_of(F.col("edited_fingerprint")).alias("edited_fingerprint"),
        fingerprints.likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        fingerprints.likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return d.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(table(spark, sf_dir, "documents")))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), percent=85).select("doc_id", "n_shingles", "component_id", "kept")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents"))


def op6_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = licences.scan(table(spark, sf_dir, "documents"))
    return d.select("doc_id", F.array_join("licences", ",").alias("licences"), F.array_join("sentence_ids", ",").alias("sentence_ids"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_path(spark, "tokens")
    token_store.write(table(spark, sf_dir, "documents"), folder, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)
    return token_store.read(spark, folder)


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(RANKS)
    ids = bpe.with_digest(bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path, public_tokenizers.PATTERN))
    return bpe.decode(ids, path).select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = html.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return d.withColumn("n_chars", F.length("text").cast("long"))


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontamination.digest(decontamination.scan(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = importance.resample(table(spark, sf_dir, "documents"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return d.select("doc_id", "n_features", "weight", "score", "rank")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return d.withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_fingerprints": op1_fingerprints,
    "op2_mixing": op2_mixing,
    "op3_pii": op3_pii,
    "op4_near_duplicates": op4_near_duplicates,
    "op5_quality_rules": op5_quality_rules,
    "op6_licences": op6_licences,
    "op7_secrets": op7_secrets,
    "op8_token_store": op8_token_store,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_html_text": op10_html_text,
    "op11_decontamination": op11_decontamination,
    "op12_importance": op12_importance,
    "op13_whitening": op13_whitening,
}

_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

_PLAIN = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"

ORACLE_SQL: dict[str, str] = {
    "op11_decontamination": f"""
WITH d AS (SELECT doc_id, {_PLAIN} AS w FROM documents),
i AS (SELECT item_id, {_PLAIN} AS w FROM benchmark),
windows AS (
  SELECT item_id, k, array_to_string(w[p:p + k - 1], ' ') AS g
  FROM (SELECT item_id, w, least(len(w), 10) AS k, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS p FROM i WHERE len(w) > 0)),
runs AS (
  SELECT doc_id, k, p, array_to_string(w[p:p + k - 1], ' ') AS g
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, (SELECT DISTINCT k FROM windows) WHERE len(w) >= k)),
hits AS (SELECT doc_id, item_id, k, p FROM runs JOIN windows USING (k, g)),
words AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM (SELECT DISTINCT doc_id, k, p FROM hits)) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op12_importance": f"""
WITH steps AS (SELECT list(list_reduce([i] || range(8), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) ORDER BY i) AS t FROM range(256) r(i)),
d AS (SELECT doc_id, {_PLAIN} AS w FROM documents),
dw AS (SELECT word, count(*) AS n FROM (SELECT unnest(w) AS word FROM d) GROUP BY 1),
tw AS (SELECT word, count(*) AS n FROM (SELECT unnest({_PLAIN}) AS word FROM benchmark) GROUP BY 1),
raw AS (SELECT word, hex(encode(word)) AS x FROM (SELECT word FROM dw UNION SELECT word FROM tw)),
buckets AS (
  SELECT word, xor(list_reduce([4294967295] || list_transform(range(0, len(x) // 2), lambda j: ('0x' || substr(x, (2 * j + 1)::INT, 2))::BIGINT), lambda a, b: xor(a >> 8, t[xor(a & 255, b) + 1])), 4294967295) % 10000 AS b
  FROM raw, steps),
own AS (SELECT b, sum(n)::BIGINT AS s FROM dw JOIN buckets USING (word) GROUP BY 1),
target AS (SELECT b, sum(n)::BIGINT AS t FROM tw JOIN buckets USING (word) GROUP BY 1),
totals AS (SELECT (SELECT coalesce(sum(s), 0)::BIGINT FROM own) AS ss, (SELECT coalesce(sum(t), 0)::BIGINT FROM target) AS tt),
gains AS (SELECT b, floor(1000 * ln(((coalesce(t, 0) + 1) * (ss + 10000))::DOUBLE / ((s + 1) * (tt + 10000))::DOUBLE))::BIGINT AS g FROM own LEFT JOIN target USING (b), totals),
weights AS (SELECT doc_id, sum(g)::BIGINT AS weight FROM (SELECT doc_id, unnest(w) AS word FROM d) JOIN buckets USING (word) JOIN gains USING (b) GROUP BY 1),
scores AS (
  SELECT doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM d LEFT JOIN weights USING (doc_id)),
places AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place, (count(*) FILTER (WHERE n_features >= 20) OVER ()) * 10 // 100 AS draw FROM scores)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= draw THEN place END AS rank FROM places""",
    "op4_near_duplicates": rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM words),
items AS (SELECT doc_id, unnest(s) AS g FROM sets),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM items a JOIN items b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN sets x ON x.doc_id = a JOIN sets y ON y.doc_id = b WHERE 100 * k >= 85 * (len(x.s) + len(y.s) - k)),
sides AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, c) AS (SELECT doc_id, doc_id FROM sets UNION SELECT r.doc_id, b.b FROM reach r JOIN sides b ON b.a = r.c)
SELECT doc_id, any_value(len(s))::BIGINT AS n_shingles, min(c) AS component_id, doc_id = min(c) AS kept FROM reach JOIN sets USING (doc_id) GROUP BY doc_id""",
    "op2_mixing": f"""
WITH sizes AS (
  SELECT doc_id, source, len({_WORDS})::BIGINT AS size,
         ('0x' || substr(sha256(coalesce(doc_id::VARCHAR, 'null')), 1, 12))::BIGINT AS h
  FROM documents),
per AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         ([1.0, 2.0, 3.0])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight
  FROM sizes GROUP BY source),
caps AS (SELECT *, (3 * source_size)::DOUBLE AS cap, (sum(source_size) OVER ())::DOUBLE AS total, sum(weight) OVER () AS all_weight FROM per),
sums AS (
  SELECT *, coalesce(sum(cap) OVER w, 0) AS full_before, all_weight - coalesce(sum(weight) OVER w, 0) AS open_weight
  FROM caps WINDOW w AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
levels AS (SELECT *, max(CASE WHEN cap > weight * ((total - full_before) / open_weight) THEN (total - full_before) / open_weight END) OVER () AS level FROM sums),
targets AS (SELECT source, source_size, CASE WHEN level IS NULL THEN cap ELSE least(cap, weight * level) END AS target FROM levels),
plan AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM targets),
p0 AS (
  SELECT s.*, p.source_size, p.target, p.whole, floor(p.target - p.whole * p.source_size)::BIGINT AS budget
  FROM sizes s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source),
p1 AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY h RANGE UNBOUNDED PRECEDING) <= budget AS c1 FROM p0),
r1 AS (SELECT *, budget - coalesce(sum(size) FILTER (WHERE c1) OVER (PARTITION BY source), 0) AS rest1 FROM p1),
p2 AS (SELECT *, NOT c1 AND size <= rest1 AND coalesce(sum(size) FILTER (WHERE NOT c1 AND size <= rest1) OVER (PARTITION BY source ORDER BY h RANGE UNBOUNDED PRECEDING), 0) <= rest1 AS c2 FROM r1),
r2 AS (SELECT *, rest1 - coalesce(sum(size) FILTER (WHERE c2) OVER (PARTITION BY source), 0) AS rest2 FROM p2),
p3 AS (SELECT *, NOT c1 AND NOT c2 AND size <= rest2 AND coalesce(sum(size) FILTER (WHERE NOT c1 AND NOT c2 AND size <= rest2) OVER (PARTITION BY source ORDER BY h RANGE UNBOUNDED PRECEDING), 0) <= rest2 AS c3 FROM r2)
SELECT doc_id, size, source_size, target, size * (whole + (c1 OR c2 OR c3)::BIGINT) AS taken FROM p3""",
}
