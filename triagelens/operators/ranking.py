"""Work over one global order without sorting everything in one task.

Values are split into ranges by a range partitioning, each range is worked on by
itself, and the totals of the earlier ranges (one small row per range) are added.
The ranged rows are written once, so a task that is run again finds the same ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from triagelens.session import stage


def with_range(df: DataFrame, column: str, ranges: int | None = None) -> DataFrame:
    """Adds ``range_no``, ascending with the value, and writes the rows once."""
    n = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stage(df.repartitionByRange(n, column).withColumn("range_no", F.spark_partition_id()), "ranked")


def running_total(df: DataFrame, column: str, value: Column, name: str, ranges: int | None = None) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over all rows with a smaller ``column``.

    ``column`` must be unique.
    """
    ranged = with_range(df.withColumn("_value", value), column, ranges)
    inside = W.partitionBy("range_no").orderBy(column).rowsBetween(W.unboundedPreceding, -1)
    local = ranged.withColumn("_inside", F.coalesce(F.sum("_value").over(inside), F.lit(0)))
    # one row per range
    totals = ranged.groupBy("range_no").agg(F.sum("_value").alias("_total"))
    earlier = W.orderBy("range_no").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select("range_no", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_offset"))
    return (
        local.join(F.broadcast(offsets), "range_no")
        .withColumn(name, F.col("_inside") + F.col("_offset"))
        .drop("_value", "_inside", "_offset", "range_no")
    )


def numbered(df: DataFrame, order: Column, name: str, ranges: int | None = None) -> DataFrame:
    """Adds ``name``: the 1-based place of a row by ``order``, which must be unique.

    Rows are numbered within their range as they are written, so they are dealt once.
    """
    n = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(n, order).sortWithinPartitions(order)
    # range in the upper bits, place in the range, from 0, in the lower 33
    ranged = stage(dealt.withColumn("_id", F.monotonically_increasing_id()), "ranked")
    parts = ranged.withColumns({"_range": F.shiftright("_id", 33), "_inside": F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))}).drop("_id")
    # one row per range
    totals = parts.groupBy("_range").agg(F.count(F.lit(1)).alias("_total"))
    earlier = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select("_range", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_offset"))
    return (
        parts.join(F.broadcast(offsets), "_range")
        .withColumn(name, (F.col("_inside") + F.col("_offset") + 1).cast("bigint"))
        .drop("_range", "_inside", "_offset")
    )


def places(df: DataFrame, group: str, order: str, name: str) -> DataFrame:
    """Adds ``name``: the place of a row, from 0, in its group by ``order``, which must be
    unique in the group. Places are counted over ranges of all rows, so no task sorts or
    holds a whole group. Rows of the null group are left out."""
    keyed = stage(df.withColumn("_key", F.struct(group, order)), "places")
    counted = stage(running_total(keyed, "_key", F.lit(1), "_before"), "places").drop("_key")
    starts = counted.groupBy(group).agg(F.min("_before").alias("_start"))
    return counted.join(starts, group).withColumn(name, F.col("_before") - F.col("_start")).drop("_before", "_start")


def add_threshold(
    df: DataFrame,
    score: str = "anomaly_score",
    threshold_percentile: float = 99.0,
    ranges: int | None = None,
) -> DataFrame:
    """Adds ``anomaly_percentile`` (average rank of ties, in percent of the rows)
    and ``is_anomalous``.  Rows without a score have neither rank nor flag."""
    known = F.col(score).isNotNull()
    # ranks are found on one row per distinct score
    counts = df.where(known).groupBy(score).agg(F.count(F.lit(1)).alias("_n"))
    ranked = running_total(counts, score, F.col("_n"), "_before", ranges)
    rows = df.select(F.count(score)).scalar()
    percentile = (F.col("_before") + (F.col("_n") + 1) / 2.0) / rows * 100.0
    levels = ranked.select(F.col(score).alias("_score"), percentile.alias("anomaly_percentile"))
    out = df.join(levels, df[score] == levels["_score"], "left").drop("_score")
    return out.withColumn(
        "is_anomalous", F.coalesce(F.col("anomaly_percentile") >= threshold_percentile, F.lit(False))
    )


def percentiles(df: DataFrame, column: str, shares: list[float], ranges: int | None = None) -> list[float]:
    """Interpolated percentiles of a column, exact for any number of rows.

    The built-in exact percentile keeps every distinct value in one task; here the
    values at the wanted ranks are looked up instead.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("_n"))
    ranked = running_total(counts, column, F.col("_n"), "_before", ranges)
    total = df.agg(F.count(column)).first()[0]
    places = [s * (total - 1) for s in shares]
    wanted = sorted({int(p) for p in places} | {min(int(p) + 1, total - 1) for p in places})
    here = F.filter(
        F.array(*[F.lit(w) for w in wanted]),
        lambda w: (w >= F.col("_before")) & (w < F.col("_before") + F.col("_n")),
    )
    found = ranked.select(F.explode(here).alias("place"), F.col(column).alias("x")).collect()  # two rows per share
    at = {r["place"]: r["x"] for r in found}
    return [
        at[int(p)] + (at[min(int(p) + 1, total - 1)] - at[int(p)]) * (p - int(p)) for p in places
    ]


def group_percentiles(df: DataFrame, group: str, column: str, shares: list[float], ranges: int | None = None) -> DataFrame:
    """``group, value, n, total, p0, p1, ...``: the distinct values of each group with their
    counts, and beside them the group's interpolated percentiles, exact, for any number of
    groups and of values in one.

    One range partitioning orders the values of all groups; a value's rank is its place in
    its range and group, and what the group has in earlier ranges.
    """
    n = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = df.where(F.col(column).isNotNull()).groupBy(group, F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    ranged = stage(counts.repartitionByRange(n, group, "value").withColumn("range_no", F.spark_partition_id()), "group-ranks")
    inside = W.partitionBy("range_no", group).orderBy("value").rowsBetween(W.unboundedPreceding, -1)
    parts = ranged.groupBy("range_no", group).agg(F.sum("n").alias("_part"))  # a row per range and group in it
    earlier = W.partitionBy(group).orderBy("range_no").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select(
        "range_no", F.col(group).alias("_group"), F.coalesce(F.sum("_part").over(earlier), F.lit(0)).alias("_earlier"),
        F.sum("_part").over(W.partitionBy(group)).alias("total"),
    )
    local = ranged.withColumn("_inside", F.coalesce(F.sum("n").over(inside), F.lit(0))).withColumnRenamed("range_no", "_range")
    ranked = local.join(parts, (F.col("_range") == F.col("range_no")) & F.col(group).eqNullSafe(F.col("_group")))
    ranked = ranked.select(group, "value", "n", "total", (F.col("_inside") + F.col("_earlier")).alias("_before"))

    def at(place):
        return F.max(F.when((place >= F.col("_before")) & (place < F.col("_before") + F.col("n")), F.col("value")))

    wanted = []
    for i, share in enumerate(shares):
        place = F.lit(share) * (F.col("total") - 1)
        low = F.floor(place)
        wanted += [at(low).alias(f"_low{i}"), at(F.least(low + 1, F.col("total") - 1)).alias(f"_high{i}"), F.max(place - low).alias(f"_part{i}")]
    found = ranked.groupBy(F.col(group).alias("_group")).agg(*wanted)
    points = [(F.col(f"_low{i}") + (F.col(f"_high{i}") - F.col(f"_low{i}")) * F.col(f"_part{i}")).alias(f"p{i}") for i in range(len(shares))]
    return ranked.drop("_before").join(found.select("_group", *points), F.col(group).eqNullSafe(F.col("_group"))).drop("_group")


def min_max(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Adds each column scaled to 0..1 under its new name; 0.0 if it is constant."""
    spans = df.select(
        F.struct(*[F.struct(F.min(c).alias("low"), F.max(c).alias("high")).alias(c) for c in names]).alias("spans")
    ).scalar()
    out = {}
    for column, name in names.items():
        low, high = spans[column]["low"], spans[column]["high"]
        scaled = (F.col(column) - low) / (high - low)
        out[name] = F.when(high.isNull() | (high == low), F.lit(0.0)).otherwise(scaled)
    return df.withColumns(out)


def score_column(df: DataFrame) -> str:
    return "ensemble_score" if "ensemble_score" in df.columns else "anomaly_score"


def top_sessions(df: DataFrame, n: int, alerts_only: bool = False) -> DataFrame:
    """The ``n`` sessions with the highest score, in order."""
    kept = df.where("is_anomalous") if alerts_only else df
    return kept.orderBy(F.desc(score_column(df)), *[c for c in ("session_id", "k_agent", "session_no") if c in df.columns]).limit(n)


def nth(ordered: DataFrame, index: int, n_columns: list) -> DataFrame:
    """The row at ``index`` (0-based) of the order ``n_columns``; an index past
    the end is an error.  Only the rows up to it are sorted, and they are written, so
    looking whether there is such a row does not run the job again."""
    if index < 0:
        raise ValueError(f"Invalid index {index}.")
    top = stage(ordered.orderBy(*n_columns).limit(index + 1), "top")
    # at most index + 1 rows
    numbered = top.withColumn("_at", F.row_number().over(W.orderBy(*n_columns)) - 1)
    picked = numbered.where(F.col("_at") == index).drop("_at")
    if picked.isEmpty():
        raise ValueError(f"Invalid index {index}: fewer rows than that.")
    return picked
