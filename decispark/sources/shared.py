"""The folder that driver and executors share, and tables in it that cut lineage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where the session names none, a local folder, but only if driver and executors are one process (tests)."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", "")
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return "/tmp/checkpoints"


def shared_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def remove(spark: SparkSession, path: str) -> None:
    files, where = _file_system(spark, path)
    files.delete(where, True)


def remove_at_end(spark: SparkSession, path: str) -> None:
    """Remove path when the application ends."""
    files, where = _file_system(spark, path)
    files.deleteOnExit(where)


def cut(df: DataFrame, tag: str, path: str | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: the lineage ends there and survives lost executors.

    The table goes when the application ends, or by remove().
    """
    spark = df.sparkSession
    path = path or shared_path(spark, tag)
    df.write.parquet(path)
    remove_at_end(spark, path)
    return spark.read.schema(df.schema).parquet(path)
