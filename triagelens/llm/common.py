"""What several operators of this package share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Space and the five control characters from tab to carriage return.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_CLASS = "[\\x20\\x09-\\x0D]"


def small_batches(spark: SparkSession, rows: int = 256) -> None:
    """Rows per Arrow batch, so that a batch of very long texts still fits a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the one that all executors share."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: cuts the lineage, survives lost executors.

    Shuffle files of the write are dropped with it, since nothing reads them again.
    """
    spark = df.sparkSession
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    path = shared_folder(spark, name)
    spark.conf.set(key, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(key, before)
    return spark.read.schema(df.schema).parquet(path)


def ranged(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """``rows`` dealt and sorted by ``keys``, nulls first, and written with ``at``: the number
    of the range in the upper bits, the position in it in the lower 33. ``keys`` should be
    short and tell rows apart, so that no range is larger than others."""
    order = [F.col(c).asc_nulls_first() for c in keys]
    return written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), name)


def pieces(rows: DataFrame, group: str) -> DataFrame:
    """``part, <group>, in_part, first_at, before``: one row for each group and range of a
    ``ranged`` table, with the group's rows in earlier ranges. A row's position in its
    group is ``before + at - first_at``."""
    parts = rows.groupBy(F.shiftright("at", 33).alias("part"), group).agg(F.count("*").alias("in_part"), F.min("at").alias("first_at"))
    earlier = Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumn("before", F.coalesce(F.sum("in_part").over(earlier), F.lit(0)))


def documents(docs: DataFrame, *columns: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, text (null reads as empty) and further ``columns``; all else is left behind."""
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        *columns,
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc32_mod(id_column: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; null for a null id."""
    return F.crc32(id_column.cast("string").cast("binary")) % n
