"""Session set-up and scratch storage shared by all jobs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

def build_session(app: str = "triagelens", master: str | None = None, conf: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.variant.allowDuplicateKeys": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **(conf or {}),
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def pin_session(spark: SparkSession) -> SparkSession:
    """Settings the results depend on: naive log times are read as UTC, and of a key
    that a JSON object repeats the last value counts."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    return spark


def scratch_root(spark: SparkSession) -> str:
    """The folder that all executors share, as the cluster names it."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return shared


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as a table and read it back.

    Used where a result feeds several branches: later branches read pruned
    columns instead of recomputing, and a lost executor only costs a re-read.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def lowest_hash(df: DataFrame, columns: list[str], n: int, seed: int = 0) -> DataFrame:
    """The ``n`` rows with the lowest hash of ``columns``: a sample that is the
    same for any partitioning.

    A task sends at most ``n`` rows to the one that merges them.
    """
    hashed = df.withColumn("_hash", F.xxhash64(F.lit(seed), *columns))
    return hashed.orderBy("_hash", *columns).limit(n).drop("_hash")

