"""Text scan with file order and 1-based line numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from triagelens.functions.text import strip

ROW_BITS = (1 << 33) - 1


def scan_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One row per line: ``value`` and ``seq``, whose order is the file order.

    ``seq`` is (path, start of the input split, row within the split), all known
    to the reading task, so ordered work needs no numbering pass.
    """
    lines = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block_start"),
        F.monotonically_increasing_id().alias("row_id"),
    )
    return lines.select(
        "value",
        F.struct("path", "block_start", F.col("row_id").bitwiseAND(ROW_BITS).alias("row")).alias("seq"),
    )


def _block_offsets(lines: DataFrame) -> DataFrame:
    """Lines before each split of a file; one row per split."""
    blocks = lines.groupBy(F.col("seq.path").alias("path"), F.col("seq.block_start").alias("block_start")).agg(
        F.count(F.lit(1)).alias("n"), F.min("seq.row").alias("first_row")
    )
    before = W.partitionBy("path").orderBy("block_start").rowsBetween(W.unboundedPreceding, -1)
    return blocks.select(
        "path", "block_start", "first_row", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("lines_before")
    )


def number_lines(lines: DataFrame, only: Column | None = None) -> DataFrame:
    """Add the exact 1-based ``line_no``; with ``only``, for the rows it keeps.

    A line number needs only the line counts of the earlier splits of its file,
    so no line is shuffled to be counted and filters such as "bad lines" apply
    before the join with the splits.
    """
    offsets = _block_offsets(lines)
    wanted = lines if only is None else lines.where(only)
    keyed = wanted.withColumn("path", F.col("seq.path")).withColumn("block_start", F.col("seq.block_start"))
    return keyed.join(offsets, ["path", "block_start"]).select(
        *[F.col(c) for c in wanted.columns],
        F.col("path"),
        (F.col("lines_before") + F.col("seq.row") - F.col("first_row") + 1).alias("line_no"),
    )


def is_blank(value: Column) -> Column:
    return strip(value) == ""


def quarantine(lines: DataFrame, reason: Column) -> DataFrame:
    """Rows with a non-null ``reason`` as (path, line_no, reason, raw, message)."""
    flagged = lines.withColumn("reason", reason)
    bad = F.col("reason").isNotNull()
    if "line_no" in lines.columns:
        numbered = flagged.where(bad)
        if "path" not in lines.columns:
            numbered = numbered.withColumn("path", F.lit(None).cast("string"))
    else:
        numbered = number_lines(flagged, only=bad)
    return numbered.select(
        "path",
        "line_no",
        "reason",
        F.col("value").alias("raw"),
        F.concat(F.lit("line "), F.col("line_no"), F.lit(": "), F.col("reason")).alias("message"),
    )


SEP = "\x1e\x01\x1e"


def captures(value: Column, pattern: str, groups: int) -> Column:
    """The groups of an anchored pattern, at positions 1.., in one regex pass.

    Position 1 and on are absent where the text does not match; read them with
    ``group``.
    """
    template = "".join(f"{SEP}${i}" for i in range(1, groups + 1))
    return F.split(F.regexp_replace(value, pattern, template), SEP, -1)


def group(captured: Column | str, number: int) -> Column:
    return F.get(F.col(captured) if isinstance(captured, str) else captured, F.lit(number))
