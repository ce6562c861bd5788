"""Files in and out: JSON lines, documents, CSV, strict trajectories, manifests, safe writes."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import cut, remove

CORRUPT = "_corrupt"


def read_json_lines(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """JSON lines, plain or gzip; blank lines are skipped and a line that is no object of the schema fails."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_json_document(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """One object per file; a file that holds anything else fails."""
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    text = spark.read.text(path, wholetext=True)
    wrong = F.raise_error(F.concat(F.lit("no JSON object: "), F.substring("value", 1, 80))).cast("string")
    whole = F.when(F.col("value").rlike(r"^\s*\{"), F.col("value")).otherwise(wrong)
    return text.select(F.from_json(whole, schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """CSV with a header that must name the schema's columns, typed strictly."""
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").csv(path)


def numbered_text(spark: SparkSession, path: str) -> DataFrame:
    """value, file and line (from 1) of every line, however many tasks read a file.

    Each split counts its own lines; running sums of those counts by place in the file are the
    offsets. The text is read where it lies and only one row for each split is shuffled.
    """
    place = ["file", "split"]
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("__id"))
    splits = raw.groupBy(*place).agg(F.min("__id").alias("__first"), F.count(F.lit(1)).alias("__lines"))
    before = F.coalesce(F.sum("__lines").over(W.partitionBy("file").orderBy("split").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    splits = cut(splits.select("file", "split", "__first", before.alias("__before")), "splits")
    few = F.broadcast(splits) if splits.count() <= 100_000 else splits
    return raw.join(few, place).select("value", "file", (F.col("__before") + F.col("__id") - F.col("__first") + 1).alias("line"))


def scan_trajectories(spark: SparkSession, path: str, schema: T.StructType, version: str, record_type: str) -> tuple[DataFrame, DataFrame]:
    """Good records, and the bad lines with file, line and problem: blank, no JSON, another version or type."""
    raw = numbered_text(spark, path)
    parsed = raw.withColumn("r", F.from_json("value", T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())]), {"columnNameOfCorruptRecord": CORRUPT}))
    problem = (
        F.when(F.trim("value") == "", "blank line")
        .when(F.col(f"r.{CORRUPT}").isNotNull() | F.col("r").isNull(), "not an object of the schema")
        .when(~F.col("r.schema_version").eqNullSafe(F.lit(version)), "schema_version")
        .when(~F.col("r.record_type").eqNullSafe(F.lit(record_type)), "record_type")
    )
    d = parsed.withColumn("problem", problem)
    return d.where("problem is null").select(*[F.col(f"r.{f.name}").alias(f.name) for f in schema.fields]), d.where("problem is not null").select("file", "line", "problem", "value")


def scan_fixtures(spark: SparkSession, path: str, version: str = "parity_fixture_v1") -> DataFrame:
    """file, value, fixture_id, step_index and problem (null: good) of every line that is not blank.

    Problems: no object, another version, a fixture_id that is no text, a step_index that is no whole
    number, a repeated (fixture_id, step_index), and raw evidence that does not match its hash as
    canonical JSON (sorted keys, no spaces).
    """
    d = spark.read.text(path).where("trim(value) <> ''").select(F.col("_metadata.file_name").alias("file"), "value")
    d = d.withColumn("v", F.try_parse_json("value"))
    get = lambda p, kind: F.try_variant_get("v", f"$.{p}", kind)
    of = lambda p: F.schema_of_variant(F.try_variant_get("v", f"$.{p}", "variant"))
    d = d.select("file", "value", "v", F.when(of("fixture_id") == "STRING", get("fixture_id", "string")).alias("fixture_id"), F.when(of("step_index") == "BIGINT", get("step_index", "bigint")).alias("step_index"))
    raw = F.when(of("real_raw_snapshot").startswith("OBJECT"), F.to_json(get("real_raw_snapshot", "variant")))
    twice = F.count(F.lit(1)).over(W.partitionBy("fixture_id", "step_index")) > 1
    problem = (
        F.when(F.col("v").isNull() | ~F.schema_of_variant("v").startswith("OBJECT"), "not an object")
        .when(~get("schema_version", "string").eqNullSafe(F.lit(version)), "schema_version")
        .when(F.coalesce(F.col("fixture_id"), F.lit("")) == "", "fixture_id")
        .when(F.col("step_index").isNull(), "step_index")
        .when(twice, "duplicate")
        .when(raw.isNull() | get("real_raw_snapshot_sha256", "string").isNull(), "raw evidence")
        .when(F.sha2(raw, 256) != get("real_raw_snapshot_sha256", "string"), "hash mismatch")
    )
    return d.withColumn("problem", problem).drop("v")


def semantic_digest(columns: list[str], dropped: list[str]) -> Column:
    """SHA-256 of a row without the columns that do not bear on behaviour (locations, bookkeeping)."""
    return row_digest([c for c in columns if c not in dropped])


def write_json_lines(df: DataFrame, path: str, order: list[str], files: int | None = None) -> None:
    """Ordered JSON lines in gzip, in as many files as their ranges; equal rows give equal lines, nulls left out."""
    ranged = df.repartitionByRange(files, *order) if files else df.repartitionByRange(*order)
    ranged.sortWithinPartitions(*order).write.mode("errorifexists").option("compression", "gzip").json(path)


def row_digest(columns: list[str]) -> Column:
    """SHA-256 of a row's columns as canonical JSON."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def table_digest(df: DataFrame, keys: list[str]) -> DataFrame:
    """records and digest of a table, whatever its order: row digests summed in 64-bit pieces, so nothing is collected."""
    pieces = [F.sum(F.conv(F.substring("d", 1 + 16 * i, 15), 16, 10).cast("decimal(38,0)")) for i in range(4)]
    d = df.select(row_digest(df.columns).alias("d"))
    return d.agg(F.count(F.lit(1)).alias("records"), F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("0")) for p in pieces]), 256).alias("digest"))


def manifest(splits: dict[str, DataFrame], keys: list[str], dataset: str, version: str) -> DataFrame:
    """One row per split: dataset, version, split, records, digest."""
    out = None
    for name, df in splits.items():
        row = table_digest(df, keys).select(F.lit(dataset).alias("dataset_id"), F.lit(version).alias("schema_version"), F.lit(name).alias("split"), "records", "digest")
        out = row if out is None else out.unionByName(row)
    return out


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """path and SHA-256 of each file's content; each file is one row, so only files of moderate size belong here."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def write_once(tables: dict[str, DataFrame], keys: list[str]) -> list[str]:
    """Write those tables whose path is free, after checking that every other path holds the same rows; the paths written.

    Raises before anything is written where a path holds other rows.
    """
    new = []
    for path, df in tables.items():
        if not exists(df.sparkSession, path):
            new.append(path)
        elif table_digest(df.sparkSession.read.parquet(path), keys).first() != table_digest(df, keys).first():
            raise ValueError(f"{path} holds other rows")
    for path in new:
        tables[path].write.mode("errorifexists").parquet(path)
    return new


#: Rows in a row group of an indexed table, so that a look-up reads little.
INDEX_ROWS = 20_000


def publish_indexed(df: DataFrame, path: str, keys: list[str], metadata: dict[str, str] | None = None, group_bytes: int = 8 << 20) -> dict[str, str]:
    """A look-up table at path: rows in key order, row groups with key ranges and Bloom filters, and its metadata.

    Everything is written beside the path and moved there in one step when it is complete and
    its keys are distinct and not null; a build that fails leaves nothing. The path must be free.
    Returns the metadata: records and digest of the rows, and what is given. Look-ups that compare the keys
    with constants read only the row groups that may hold them.
    """
    spark = df.sparkSession
    if exists(spark, path):
        raise FileExistsError(path)
    staging = f"{path}.building-{uuid.uuid4().hex}"
    rows = f"{staging}/rows"
    try:
        writer = df.repartitionByRange(*keys).sortWithinPartitions(*keys).write.option("parquet.block.size", group_bytes).option("parquet.page.row.count.limit", INDEX_ROWS)
        for k in keys:
            writer = writer.option(f"parquet.bloom.filter.enabled#{k}", True)
        writer.parquet(rows)
        written = spark.read.parquet(rows)
        null_key = F.lit(False)
        for k in keys:
            null_key = null_key | F.col(k).isNull()
        wrong = written.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) | null_key)
        if (first := wrong.first()) is not None:
            raise ValueError(f"key is null or repeated: {first.asDict()}")
        found = table_digest(written, keys).first().asDict()
        about = {**{k: str(v) for k, v in found.items()}, **(metadata or {})}
        spark.createDataFrame(sorted(about.items()), "key string, value string").coalesce(1).write.json(f"{staging}/metadata")
        move(spark, staging, path)
    except BaseException:
        remove(spark, staging)
        raise
    return about


def move(spark: SparkSession, source: str, path: str) -> None:
    """Rename within one file system; fails where the path is taken."""
    jvm = spark._jvm.org.apache.hadoop.fs.Path
    files = jvm(source).getFileSystem(spark._jsc.hadoopConfiguration())
    if files.exists(jvm(path)) or not files.rename(jvm(source), jvm(path)):
        raise FileExistsError(path)


def look_up(spark: SparkSession, path: str, **key: object) -> DataFrame:
    """The rows of an indexed table with these keys; a list of values is a set of them."""
    d = spark.read.parquet(f"{path}/rows")
    for k, v in key.items():
        d = d.where(F.col(k).isin(v) if isinstance(v, list) else F.col(k) == F.lit(v))
    return d


def look_up_all(spark: SparkSession, path: str, keys: DataFrame, most: int = 1000) -> DataFrame:
    """The rows of an indexed table whose key is among keys (one column of its name).

    Up to `most` keys are compared as constants, so that row groups without them are skipped; more keys are
    joined, which is cheaper than a long list.
    """
    (name,) = keys.columns
    wanted = keys.where(F.col(name).isNotNull()).distinct()
    few = [r[0] for r in wanted.limit(most + 1).collect()]
    return look_up(spark, path, **{name: few}) if len(few) <= most else spark.read.parquet(f"{path}/rows").join(wanted, name, "left_semi")


def index_metadata(spark: SparkSession, path: str) -> dict[str, str]:
    return {r["key"]: r["value"] for r in spark.read.schema("key string, value string").json(f"{path}/metadata").collect()}


def append_new(df: DataFrame, path: str, keys: list[str]) -> None:
    """Append the rows whose key the table lacks: a rerun appends nothing."""
    spark = df.sparkSession
    fresh = df.dropDuplicates(keys)
    if exists(spark, path):
        fresh = fresh.join(spark.read.parquet(path).select(*keys), keys, "left_anti")
    fresh.write.mode("append").parquet(path)


def resumed(done: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """All finished rows, and the fresh ones whose key is not among them."""
    return done.unionByName(fresh.join(done.select(*keys), keys, "left_anti"))


def compacted(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row per key with its rows in order; keys with repeated places are flagged."""
    rest = [c for c in rows.columns if c != key]
    d = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, *[c for c in rest if c not in order]))).alias("rows"), F.countDistinct(*order).alias("places"))
    return d.select(key, "rows", (F.size("rows") == F.col("places")).alias("unique_places"))


def first_per_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    w = W.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
