"""Files: round trips through JSON lines, CSV and strict scans; manifests, appends and resumption."""

from __future__ import annotations

from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from decispark.sources import files, shared
from decispark.streaming import logs

from .registry import load, query


def _folder(spark) -> str:
    return shared.shared_path(spark, "files")


@query("s01_s08_json_lines", "SELECT doc_id, lang, source, n_chars FROM documents")
def s01(spark, sf_dir):
    d, path = load(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars"), _folder(spark)
    files.write_json_lines(d, path, ["doc_id"])
    return files.read_json_lines(spark, path, d.schema)


@query("s05_csv", "SELECT p_partkey, p_name, p_size FROM part")
def s05(spark, sf_dir):
    d, path = load(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size"), _folder(spark)
    d.write.option("header", True).csv(path)
    return files.read_csv(spark, path, d.schema)


@query("s02_strict_scan", """WITH l AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id % 16 ORDER BY conv_id, turn) AS line FROM conversations)
SELECT conv_id % 16 AS part, line, CASE WHEN turn % 5 = 2 THEN 'blank line' WHEN turn % 5 = 3 THEN 'schema_version' WHEN turn % 5 = 4 THEN 'not an object of the schema' ELSE 'good' END AS problem FROM l WHERE turn % 5 > 1
UNION ALL SELECT -1, count(*), 'good' FROM conversations WHERE turn % 5 <= 1""")
def s02(spark, sf_dir):
    """Conversations in sixteen files; the bad lines with file and line, and the number of good ones."""
    c, path, t = load(spark, sf_dir, "conversations"), _folder(spark), F.col("turn")
    version = F.when(t % 5 == 3, "v0").otherwise("trajectory_v1")
    line = F.to_json(F.struct(version.alias("schema_version"), F.lit("transition").alias("record_type"), "conv_id", "turn"))
    lines = F.when(t % 5 == 4, F.lit("{broken")).when(t % 5 == 2, F.lit(" ")).otherwise(line)
    part = F.col("conv_id") % 16
    c.select(lines.alias("value"), part.alias("part"), "conv_id", "turn").repartition(16, "part").sortWithinPartitions("part", "conv_id", "turn").select("value", "part").write.partitionBy("part").text(path)
    schema = T.StructType().add("schema_version", "string").add("record_type", "string").add("conv_id", "long").add("turn", "long")
    good, bad = files.scan_trajectories(spark, path, schema, "trajectory_v1", "transition")
    of_file = F.regexp_extract("file", r"part=(\d+)", 1).cast("long")
    return bad.select(of_file.alias("part"), "line", "problem").unionByName(good.agg(F.count(F.lit(1)).alias("line")).select(F.lit(-1).cast("long").alias("part"), "line", F.lit("good").alias("problem")))


@query("s07_s09_s10_write_once", "SELECT p_partkey, p_brand FROM part")
def s09(spark, sf_dir):
    d, path = load(spark, sf_dir, "part").select("p_partkey", "p_brand"), _folder(spark)
    files.write_once({path: d}, ["p_partkey"])
    files.write_once({path: d}, ["p_partkey"])
    return spark.read.parquet(path)


@query("s11_append_new", "SELECT o_orderkey, o_custkey FROM orders")
def s11(spark, sf_dir):
    d, path = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), _folder(spark)
    files.append_new(d.where("o_orderkey % 3 <> 0"), path, ["o_orderkey"])
    files.append_new(d, path, ["o_orderkey"])
    return spark.read.parquet(path)


@query("s06_s07_indexed_table", "SELECT o_orderkey, o_custkey, o_orderkey % 97 = 5 AS looked_up FROM orders")
def s07(spark, sf_dir):
    """Orders as a look-up table, published at once; some of its keys are looked up."""
    d, path = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), _folder(spark)
    files.publish_indexed(d, path, ["o_orderkey"], {"source": "orders"})
    keys = spark.read.parquet(f"{path}/rows").where("o_orderkey % 97 = 5").select("o_orderkey")
    found = files.look_up_all(spark, path, keys).select("o_orderkey", F.lit(True).alias("hit"))
    return spark.read.parquet(f"{path}/rows").join(found, "o_orderkey", "left").select("o_orderkey", "o_custkey", F.coalesce("hit", F.lit(False)).alias("looked_up"))


@query("s11_append_sink", "SELECT o_orderkey, o_custkey FROM orders")
def s11_sink(spark, sf_dir):
    """A stream of orders, each delivered twice, whose first run stops between writing and commit."""
    o, folder = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), _folder(spark)
    o.unionByName(o).write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(o.schema).parquet(f"{folder}/in")

    def stop(_: str) -> None:
        raise InterruptedError("stopped before the commit")

    try:
        logs.append_sink(stream, f"{folder}/out", ["o_orderkey"], f"{folder}/state", stop)
    except StreamingQueryException:
        logs.append_sink(stream, f"{folder}/out", ["o_orderkey"], f"{folder}/state")
    return logs.committed(spark, f"{folder}/out").select("o_orderkey", "o_custkey")


@query("s12_compacted", "SELECT l_orderkey, count(*) AS n, count(*) = count(DISTINCT l_linenumber) AS unique_places FROM lineitem GROUP BY 1")
def s12(spark, sf_dir):
    d = files.compacted(load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), "l_orderkey", ["l_linenumber"])
    return d.select("l_orderkey", F.size("rows").cast("long").alias("n"), "unique_places")


@query("s14_q03_resumed", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'old' ELSE 'new' END AS run FROM orders")
def s14(spark, sf_dir):
    o = load(spark, sf_dir, "orders").select("o_orderkey")
    return files.resumed(o.where("o_orderkey % 2 = 0").withColumn("run", F.lit("old")), o.withColumn("run", F.lit("new")), ["o_orderkey"])


@query("s16_manifest", """WITH r AS (SELECT CASE WHEN doc_id % 5 = 0 THEN 'dev' ELSE 'train' END AS split, sha256('{"doc_id":' || doc_id || ',"lang":' || coalesce(to_json(lang)::VARCHAR, 'null') || ',"text":' || coalesce('"' || sha256(text) || '"', 'null') || '}') AS d FROM documents),
s AS (SELECT split, count(*) AS records, [sum(('0x' || substr(d, 1, 15))::HUGEINT), sum(('0x' || substr(d, 17, 15))::HUGEINT), sum(('0x' || substr(d, 33, 15))::HUGEINT), sum(('0x' || substr(d, 49, 15))::HUGEINT)] AS p FROM r GROUP BY 1)
SELECT 'documents' AS dataset_id, 'v1' AS schema_version, split, records, sha256(p[1]::VARCHAR || '|' || p[2]::VARCHAR || '|' || p[3]::VARCHAR || '|' || p[4]::VARCHAR) AS digest FROM s""")
def s16(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("text"), "lang")
    return files.manifest({"train": d.where("doc_id % 5 <> 0"), "dev": d.where("doc_id % 5 = 0")}, ["doc_id"], "documents", "v1")


@query("s21_file_digests")
def s21(spark, sf_dir):
    return files.file_digests(spark, f"{sf_dir}/region.parquet").select("length", "sha256")


@query("s04_json_document", "SELECT n_nationkey, n_name FROM nation")
def s04(spark, sf_dir):
    """One object per file, over several lines."""
    d, path = load(spark, sf_dir, "nation").select("n_nationkey", "n_name"), _folder(spark)
    lines = F.regexp_replace(F.to_json(F.struct("n_nationkey", "n_name")), "([{,])", "$1\n  ")
    d.select(lines.alias("value"), F.col("n_nationkey").alias("file")).write.partitionBy("file").text(path)
    return files.read_json_document(spark, f"{path}/*", d.schema)


@query("s15_fixtures", """WITH c AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations),
x AS (SELECT conv_id, CASE WHEN turn = 4 THEN 3 ELSE turn END AS step, turn FROM c)
SELECT CASE WHEN turn % 7 = 6 THEN 'schema_version' WHEN turn % 7 = 5 THEN 'step_index' WHEN count(*) FILTER (WHERE turn % 7 <> 5) OVER (PARTITION BY conv_id, step) > 1 THEN 'duplicate' WHEN turn % 7 = 2 THEN 'hash mismatch' ELSE 'good' END AS problem FROM x""")
def s15(spark, sf_dir):
    c, path, t = load(spark, sf_dir, "conversations"), _folder(spark), F.col("turn")
    step = F.when(t % 7 == 5, F.lit('"five"')).otherwise(F.when(t == 4, 3).otherwise(t).cast("string"))
    canonical = F.concat(F.lit('{"a":'), t.cast("string"), F.lit(',"b":"x"}'))
    raw = F.concat(F.lit('{"b": "x", "a": '), t.cast("string"), F.lit("}"))
    digest = F.sha2(F.when(t % 7 == 2, F.lit("other")).otherwise(canonical), 256)
    line = F.concat(
        F.lit('{"schema_version":"'), F.when(t % 7 == 6, "v0").otherwise("parity_fixture_v1"), F.lit('","fixture_id":"c'), F.col("conv_id").cast("string"), F.lit('","step_index":'), step,
        F.lit(',"real_raw_snapshot":'), raw, F.lit(',"real_raw_snapshot_sha256":"'), digest, F.lit('"}'),
    )
    c.select(line.alias("value")).write.text(path)
    return files.scan_fixtures(spark, path).select(F.coalesce("problem", F.lit("good")).alias("problem"))
