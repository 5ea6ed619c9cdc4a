"""Streaming forms of the simple groupings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triagelens.functions.text import blank_to_null, count_where, iso_text, ratio
from triagelens.operators.generic_incidents import ENTITIES, check_window, classify_generic, group_key
from triagelens.operators.sessions import KEYS, identity_columns, session_id, with_identity


def stream_lines(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """Lines of the files that arrive in a folder, for the line parsers."""
    lines = spark.readStream.option("maxFilesPerTrigger", max_files).text(path)
    order = F.struct("_metadata.file_modification_time", "_metadata.file_path", "_metadata.file_block_start")
    return lines.select("value", order.alias("seq"))


def stream_generic_incidents(events: DataFrame, window_minutes: int = 15, late: str = "10 minutes") -> DataFrame:
    """Incidents per group key and bucket, emitted when the watermark passes the
    bucket.  Later rows are dropped; the query's progress counts them.

    Buckets are event-time windows, so the width must divide an hour.  Two aggregations
    follow each other: the first has one state row per (group, bucket, kind, name), so a hot
    group is spread over its names and distinct entities are exact; the second adds these
    rows up when the first hands them out.
    """
    check_window(window_minutes)
    if 60 % window_minutes:
        raise ValueError("in a stream the window must divide 60 minutes")
    level, action = F.lower("severity"), F.lower("event_action")
    # every event is one row per kind; it is counted in the rows of the first kind
    names = F.array(*[F.struct(F.lit(c).alias("kind"), blank_to_null(F.col(c)).alias("name")) for c in ENTITIES])
    per_name = (
        events.withColumn("group_key", group_key())
        .withWatermark("event_ts", late)
        .select(
            "group_key", "event_ts", F.explode(names).alias("e"),
            (level == "error").alias("is_error"),
            level.isin("warn", "warning").alias("is_warning"),
            (action == "login_failed").alias("is_failed"),
        )
        .groupBy("group_key", F.window("event_ts", f"{window_minutes} minutes"), "e.kind", "e.name")
        .agg(
            F.count(F.lit(1)).alias("n"),
            count_where(F.col("is_error")).alias("errors"),
            count_where(F.col("is_warning")).alias("warnings"),
            F.coalesce(F.bool_or("is_failed"), F.lit(False)).alias("failed"),
            F.min("event_ts").alias("first_ts"),
            F.max("event_ts").alias("last_ts"),
        )
    )
    kind = F.col("kind")
    once_each = kind == next(iter(ENTITIES))
    counted = per_name.groupBy("group_key", "window").agg(
        F.sum(F.when(once_each, F.col("n")).otherwise(0)).alias("event_count"),
        F.sum(F.when(once_each, F.col("errors")).otherwise(0)).alias("error_count"),
        F.sum(F.when(once_each, F.col("warnings")).otherwise(0)).alias("warning_count"),
        F.bool_or("failed").alias("any_login_failed"),
        F.min("first_ts").alias("first_ts"),
        F.max("last_ts").alias("last_ts"),
        *[count_where((kind == c) & F.col("name").isNotNull()).alias(n) for c, n in ENTITIES.items()],
    )
    return classify_generic(counted).select(
        "group_key",
        F.col("window.start").alias("bucket_start"),
        "severity", "confidence", "priority", "attack_pattern", "event_count", "error_count", "warning_count",
        *ENTITIES.values(),
        iso_text(F.col("first_ts")).alias("first_seen"),
        iso_text(F.col("last_ts")).alias("last_seen"),
    )


def stream_sessions(events: DataFrame, gap_minutes: int = 30, late: str = "10 minutes") -> DataFrame:
    """Sessions with their counts and ratios, emitted once they are closed."""
    status = F.col("status")
    level = F.coalesce("level", "user_agent") if "level" in events.columns else F.col("user_agent")
    counted = (
        with_identity(events)
        .withWatermark("ts", late)
        .groupBy(*KEYS, F.session_window("ts", f"{gap_minutes} minutes").alias("w"))
        .agg(
            F.count(F.lit(1)).alias("event_count"),
            F.min("ts").alias("start_time"),
            F.max("ts").alias("end_time"),
            count_where(status.between(400, 499)).alias("status_4xx"),
            count_where(status.between(500, 599)).alias("status_5xx"),
            count_where(status == 401).alias("auth_failed"),
            count_where(status == 200).alias("auth_success"),
            count_where(level == "error").alias("error_events"),
            count_where(level == "notice").alias("notice_events"),
        )
    )
    n = F.col("event_count")
    return counted.select(
        session_id(F.col("k_ip"), F.col("k_user"), F.col("start_time")).alias("session_id"),
        *identity_columns(),
        "start_time", "end_time", "event_count", "status_4xx", "status_5xx", "auth_failed", "auth_success",
        "error_events", "notice_events",
        ratio(F.col("status_4xx") + F.col("status_5xx"), n).alias("error_ratio"),
        ratio(F.col("auth_failed"), F.col("auth_failed") + F.col("auth_success")).alias("auth_fail_ratio"),
        ratio(F.col("error_events"), n).alias("error_event_ratio"),
    )


def run_to_table(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Process what is there, append it to a table and read the table."""
    query = (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


END = "9000-01-01 00:00:00"


def with_end(events: DataFrame, time: str, end_path: str) -> DataFrame:
    """The stream together with the end marker that ``run_to_end`` puts into the folder."""
    marker = events.sparkSession.readStream.schema(f"{time} timestamp").parquet(end_path)
    return events.unionByName(marker, allowMissingColumns=True)


def run_to_end(make, events: DataFrame, time: str, path: str, checkpoint: str) -> DataFrame:
    """Process what is there, then end the input: what is still open is closed and emitted.

    ``make`` builds the query from the events. After the input has been worked off, one row
    far in the future, with nothing but a time, is fed into the same query; the watermark
    passes all groups. The marker's own group stays open for ever. Rows that arrive after
    that are late, so a checkpoint that was ended takes no more input.
    """
    spark = events.sparkSession
    end_path = f"{checkpoint}-end"
    marker = spark.range(1).select(F.lit(END).cast("timestamp").alias(time))
    marker.limit(0).write.mode("ignore").parquet(end_path)
    stream = make(with_end(events, time, end_path))
    run_to_table(stream, path, checkpoint)
    if spark.read.schema(marker.schema).parquet(end_path).isEmpty():
        marker.write.mode("append").parquet(end_path)
    return run_to_table(stream, path, checkpoint)
