"""SSH incidents: sessions of one ip merged while they follow closely."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from triagelens.functions import rules
from triagelens.functions.text import once, ratio, text
from triagelens.operators.sessions import SECOND, SESSION, slice_of

INCIDENT = ["ip", "cluster_index"]
SLICE_SECONDS = 3600


def _new_cluster(start: Column, previous_end: Column, window_us: int) -> Column:
    return F.coalesce(F.unix_micros(start) - F.unix_micros(previous_end) > window_us, F.lit(False)).cast("bigint")


def cluster_sessions(sessions: DataFrame, merge_window_minutes: float = 60) -> DataFrame:
    """Sessions with an ip, and their 0-based ``cluster_index`` within it.

    In the order (start, user, agent) a session opens a new cluster when it
    starts more than the window after the end of the session just before it --
    not after the latest end so far.
    """
    window_us = int(merge_window_minutes * 60 * SECOND)
    known = sessions.where("ip IS NOT NULL AND ip <> ''")
    starts = _cluster_starts(known, window_us)
    # sessions starting together never part, so the index depends on the start
    return known.join(starts, ["ip", "start_time"])


def _cluster_starts(known: DataFrame, window_us: int) -> DataFrame:
    """``cluster_index`` per (ip, start), by slices of an hour and their edges.

    One ip may have a third of all sessions: they are combined per start before
    the shuffle, and a task holds one hour of an ip, then one row per hour.
    """
    starts = known.groupBy("ip", "start_time").agg(
        F.max_by("end_time", F.struct("k_user", "k_agent")).alias("end_time")
    ).withColumn("hour_no", slice_of(F.unix_micros("start_time"), SLICE_SECONDS))
    within = W.partitionBy("ip", "hour_no").orderBy("start_time")
    local = starts.withColumn(
        "_opens", _new_cluster(F.col("start_time"), F.lag("end_time").over(within), window_us)
    ).withColumn("_local", F.sum("_opens").over(within.rowsBetween(W.unboundedPreceding, 0)))
    hours = local.groupBy("ip", "hour_no").agg(
        F.min("start_time").alias("first_start"),
        F.max_by("end_time", "start_time").alias("tail_end"),
        F.sum("_opens").alias("opened"),
    )
    along = W.partitionBy("ip").orderBy("hour_no")
    edges = hours.withColumn("_edge", _new_cluster(F.col("first_start"), F.lag("tail_end").over(along), window_us))
    offsets = edges.select(
        "ip",
        "hour_no",
        (
            F.sum("_edge").over(along.rowsBetween(W.unboundedPreceding, 0))
            + F.coalesce(F.sum("opened").over(along.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        ).alias("_offset"),
    )
    return local.join(offsets, ["ip", "hour_no"]).select(
        "ip", "start_time", (F.col("_local") + F.col("_offset")).alias("cluster_index")
    )


def incident_id(ip: Column, index: Column) -> Column:
    return text("ip:", ip, "#", index)


def incident_members(clustered: DataFrame) -> DataFrame:
    """Sessions of every incident, one row each: the whole membership."""
    return clustered.withColumn("incident_id", incident_id(F.col("ip"), F.col("cluster_index")))


def roll_up(clustered: DataFrame, min_sessions: int = 1) -> DataFrame:
    """One classified row per incident.

    A first aggregate by user keeps the second one small: an ip that tries many
    users is combined per user before its rows meet.
    """
    per_user = clustered.groupBy(*INCIDENT, "user").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("start_time").alias("first_seen"),
        F.max("end_time").alias("last_end"),
        F.max("start_time").alias("last_start"),
        F.sum("event_count").alias("event_count"),
        F.sum("anomaly_score").alias("score_sum"),
        F.sum("auth_failed").alias("auth_failed"),
        F.sum("auth_success").alias("auth_success"),
        F.max("auth_failed_streak_max").alias("streak"),
        F.max("auth_burst_max_per_minute").alias("burst"),
    )
    named = F.col("user").isNotNull()
    total = per_user.groupBy(*INCIDENT).agg(
        F.sum("n").alias("session_count"),
        F.sum("event_count").alias("total_events"),
        # to 12 places: a sum of doubles depends on the order of addition
        F.round(F.sum("score_sum") / F.sum("n"), 12).alias("avg_anomaly_score"),
        F.sum("auth_failed").alias("auth_failed"),
        F.sum("auth_success").alias("auth_success"),
        F.max("streak").alias("auth_failed_streak_max"),
        F.max("burst").alias("auth_burst_max_per_minute"),
        F.count_if(named).alias("distinct_users"),
        # most sessions first, then the user seen earliest
        F.min(F.when(named, F.struct((-F.col("n")).alias("n"), "first_seen", "user"))).alias("top"),
        F.min("first_seen").alias("first_seen"),
        F.max(F.greatest("last_end", "last_start")).alias("last_seen"),
    )
    kept = total.where(F.col("session_count") >= min_sessions)
    kept = once(kept, "auth_fail_ratio", ratio(F.col("auth_failed"), F.col("auth_failed") + F.col("auth_success")))
    return classify(
        kept.withColumn("primary_user", F.col("top.user"))
        .withColumn("user", F.col("top.user"))
        .withColumn("has_success_after_failures", (F.col("auth_failed") > 0) & (F.col("auth_success") > 0))
        .withColumn("incident_id", incident_id(F.col("ip"), F.col("cluster_index")))
        .drop("top")
    )


def classify(incidents: DataFrame) -> DataFrame:
    """Severity, confidence, pattern and priority with their reasons."""
    c = F.col
    core = (c("avg_anomaly_score"), c("auth_failed"), c("auth_fail_ratio"))
    tail = (c("has_success_after_failures"), c("auth_failed_streak_max"), c("auth_burst_max_per_minute"))
    pattern = (
        c("auth_failed"), c("auth_success"), c("auth_fail_ratio"), c("distinct_users"), c("has_success_after_failures"),
    )
    graded = incidents.withColumns(
        {
            "severity_reason": rules.ssh_severity_reason(*core, *tail),
            "confidence_reason": rules.ssh_confidence_reason(*core, c("session_count"), *tail),
            "attack_pattern": rules.ssh_pattern(*pattern),
            "attack_pattern_reason": rules.ssh_pattern_reason(*pattern),
        }
    )
    # severity and confidence feed several columns
    graded = once(graded, "severity", rules.ssh_severity(*core, *tail))
    graded = once(graded, "confidence", rules.ssh_confidence(*core, c("session_count"), *tail))
    graded = once(graded, "priority_score", rules.priority_score(c("severity"), c("confidence")))
    return graded.withColumns(
        {
            "priority": rules.priority_band(c("priority_score")),
            "priority_reason": rules.priority_reason(c("severity"), c("confidence"), c("priority_score")),
        }
    )


def ssh_incidents(scored: DataFrame, merge_window_minutes: float = 60, min_sessions: int = 1) -> DataFrame:
    return roll_up(cluster_sessions(scored, merge_window_minutes), min_sessions)


def join_scores(sessions: DataFrame, scores: DataFrame) -> DataFrame:
    """Sessions with their score columns, joined on the full session key."""
    extra = [c for c in scores.columns if c not in sessions.columns]
    return sessions.join(scores.select(*SESSION, *extra), SESSION, "inner")


def restrict_sessions(sessions: DataFrame, kept: DataFrame) -> DataFrame:
    """The sessions whose key is in ``kept``."""
    return sessions.join(kept.select(*SESSION), SESSION, "left_semi")


# --- filters and orders -----------------------------------------------------


def filter_incidents(
    incidents: DataFrame,
    min_severity: str | None = None,
    min_confidence: str | None = None,
    patterns: list[str] | None = None,
) -> DataFrame:
    """Incidents at or above the levels and with one of the patterns; an absent
    limit or an empty list lets all through."""
    out = incidents
    for column, level in (("severity", min_severity), ("confidence", min_confidence)):
        if level:
            out = out.where(rules.rank_of(F.col(column)) >= rules.LEVEL_RANK[level])
    return out.where(F.col("attack_pattern").isin(list(patterns))) if patterns else out


TIES = ["ip", "cluster_index"]


def incident_order(by: str | None = None) -> list[Column]:
    """Sort columns, highest first; ``None`` is the order of the incident list."""
    severity = rules.rank_of(F.col("severity"))
    orders = {
        None: [severity, "avg_anomaly_score"],
        "severity": [severity, "avg_anomaly_score", "total_events"],
        "avg_score": ["avg_anomaly_score", "total_events"],
        "auth_fail_ratio": ["auth_fail_ratio", "auth_failed", "total_events"],
        "total_events": ["total_events", "auth_failed", "avg_anomaly_score"],
    }
    if by not in orders:
        raise ValueError(f"unknown sort order {by!r}")
    return [F.desc(c) if isinstance(c, str) else c.desc() for c in orders[by]] + [F.asc(c) for c in TIES]


def sort_incidents(incidents: DataFrame, by: str | None = "severity") -> DataFrame:
    return incidents.orderBy(*incident_order(by))


# --- timeline ---------------------------------------------------------------


def timeline(clustered: DataFrame, more: list[str] | tuple = ()) -> DataFrame:
    """One row per session of an incident, with ``more`` of its columns; order by incident, time, session."""
    return incident_members(clustered).select(
        "incident_id",
        F.col("start_time").alias("timestamp"),
        "session_id",
        "ip",
        "user",
        "auth_failed",
        "auth_success",
        "event_count",
        "anomaly_score",
        rules.timeline_event_type(F.col("auth_failed"), F.col("auth_success")).alias("event_type"),
        *more,
    )


def timeline_order() -> list[Column]:
    return [F.asc_nulls_last("timestamp"), F.asc("session_id")]


def with_member_lists(incidents: DataFrame, clustered: DataFrame) -> DataFrame:
    """Adds ``session_ids`` (in order) and ``targeted_users`` (sorted), always whole.

    A list is as long as its incident; ``incident_members`` holds the same as rows.
    """
    lists = (
        clustered.join(incidents.select(*INCIDENT), INCIDENT, "left_semi")
        .groupBy(*INCIDENT)
        .agg(
            F.array_sort(F.collect_list(F.struct("start_time", "k_user", "k_agent", "session_id"))).alias("m"),
            F.array_sort(F.collect_set("user")).alias("targeted_users"),
        )
        .select(*INCIDENT, F.transform("m", lambda x: x["session_id"]).alias("session_ids"), "targeted_users")
    )
    return incidents.join(lists, INCIDENT, "left")
