"""Gap sessions per identity (ip, user, user agent).

Two events of one identity in the same slice of time, not wider than the gap,
are never in different sessions.  So sessions are numbered on one row per
(identity, slice) -- an aggregate with map-side combine -- and no task sorts all
events of an identity, which may be a third of the data (all Apache error lines
share the empty identity).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from triagelens.functions.text import empty_to_null, iso_text, text

KEYS = ["k_ip", "k_user", "k_agent"]
SESSION = [*KEYS, "session_no"]
SECOND = 1_000_000


def with_identity(events: DataFrame) -> DataFrame:
    """Identity keys with null and empty as the same value."""
    return events.withColumns(
        {
            "k_ip": F.coalesce("ip", F.lit("")),
            "k_user": F.coalesce("user", F.lit("")),
            "k_agent": F.coalesce("user_agent", F.lit("")),
        }
    )


def slice_of(us: Column, seconds: float) -> Column:
    """Number of the slice of time holding ``us`` microseconds (floor, also before 1970)."""
    width = int(seconds * SECOND)
    return ((us - F.pmod(us, F.lit(width))) / width).cast("bigint")


def number_sessions(slices: DataFrame, gap_minutes: float, order: list[str], by: list[str] = KEYS) -> DataFrame:
    """Adds ``session_no`` and ``is_start`` to rows of (identity, ordered slice)
    holding ``first_us`` and ``last_us``.  An identity (``by``) has at most one row per
    slice of time, however many events it has."""
    along = W.partitionBy(*by).orderBy(*order)
    gap = int(gap_minutes * 60 * SECOND)
    previous = F.lag("last_us").over(along)
    return (
        slices.withColumn("prev_last_us", previous)
        .withColumn(
            "is_start", F.col("prev_last_us").isNull() | (F.col("first_us") - F.col("prev_last_us") > gap)
        )
        .withColumn(
            "session_no",
            F.sum(F.col("is_start").cast("bigint")).over(along.rowsBetween(W.unboundedPreceding, 0)) - 1,
        )
    )


def session_id(ip: Column, user: Column, start: Column) -> Column:
    """Display id; the user agent is not part of it, so join on ``SESSION``."""
    return text(F.coalesce(ip, F.lit("")), "||", F.coalesce(user, F.lit("")), "||", iso_text(start))


def identity_columns() -> list[Column]:
    return [
        empty_to_null(F.col("k_ip")).alias("ip"),
        empty_to_null(F.col("k_user")).alias("user"),
        empty_to_null(F.col("k_agent")).alias("user_agent"),
    ]


def sessionize(events: DataFrame, gap_minutes: float = 30) -> DataFrame:
    """Events with their ``session_no`` (0-based per identity), ``session_start``
    and ``session_id``.  A gap of exactly ``gap_minutes`` does not split."""
    sliced = with_identity(events).withColumn("slice", slice_of(F.unix_micros("ts"), gap_minutes * 60))
    slices = sliced.groupBy(*KEYS, "slice").agg(
        F.min(F.unix_micros("ts")).alias("first_us"), F.max(F.unix_micros("ts")).alias("last_us")
    )
    numbered = number_sessions(slices, gap_minutes, ["slice"])
    starts = W.partitionBy(*KEYS, "session_no")
    found = numbered.select(
        *KEYS, "slice", "session_no", F.timestamp_micros(F.min("first_us").over(starts)).alias("session_start")
    )
    joined = sliced.join(found, [*KEYS, "slice"])
    return joined.withColumn(
        "session_id", session_id(F.col("k_ip"), F.col("k_user"), F.col("session_start"))
    ).drop("slice")


def session_table(events: DataFrame, gap_minutes: float = 30) -> DataFrame:
    """One row per session with its bounds and event count."""
    slices = (
        with_identity(events)
        .withColumn("slice", slice_of(F.unix_micros("ts"), gap_minutes * 60))
        .groupBy(*KEYS, "slice")
        .agg(
            F.min(F.unix_micros("ts")).alias("first_us"),
            F.max(F.unix_micros("ts")).alias("last_us"),
            F.count(F.lit(1)).alias("n"),
        )
    )
    numbered = number_sessions(slices, gap_minutes, ["slice"])
    table = numbered.groupBy(*SESSION).agg(
        F.timestamp_micros(F.min("first_us")).alias("start_time"),
        F.timestamp_micros(F.max("last_us")).alias("end_time"),
        F.sum("n").alias("event_count"),
    )
    return table.select(
        *SESSION,
        session_id(F.col("k_ip"), F.col("k_user"), F.col("start_time")).alias("session_id"),
        *identity_columns(),
        "start_time",
        "end_time",
        "event_count",
    )
