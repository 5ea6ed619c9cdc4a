"""Summaries and reports as long tables of counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triagelens.functions.text import count_where, empty_to_null, rounded
from triagelens.operators.ranking import group_percentiles, percentiles, score_column


def count_by(df: DataFrame, dimensions: dict[str, Column]) -> DataFrame:
    """Rows per value of each dimension: (dimension, value, n), in one pass.

    Null values are not counted.  Each row is counted once per dimension and
    combined before the shuffle, so a frequent value is no hot spot.
    """
    cells = F.array(*[F.struct(F.lit(d).alias("dimension"), v.cast("string").alias("value")) for d, v in dimensions.items()])
    return (
        df.select(F.explode(cells).alias("c"))
        .select("c.dimension", "c.value")
        .where("value IS NOT NULL")
        .groupBy("dimension", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _or_unknown(name: str) -> Column:
    return F.coalesce(empty_to_null(F.col(name)), F.lit("unknown"))


def generic_summary(events: DataFrame) -> DataFrame:
    """Total and counts by severity, category and action."""
    return count_by(
        events,
        {
            "total_events": F.lit("all"),
            "severity": _or_unknown("severity"),
            "event_category": _or_unknown("event_category"),
            "event_action": _or_unknown("event_action"),
        },
    )


def ssh_summary(events: DataFrame, approximate: bool = False) -> DataFrame:
    """Total, counts by severity and action, distinct users and source ips."""
    counts = count_by(
        events,
        {"total_events": F.lit("all"), "severity": _or_unknown("severity"), "event_action": _or_unknown("event_action")},
    )
    entities = {"distinct_users": "user", "distinct_src_ips": "src_ip"}
    if approximate:
        one = events.agg(*[F.approx_count_distinct(empty_to_null(F.col(c))).alias(d) for d, c in entities.items()])
        distinct = one.unpivot([], list(entities), "dimension", "n").select("dimension", F.lit("all").alias("value"), "n")
    else:
        names = count_by(events, {d: empty_to_null(F.col(c)) for d, c in entities.items()})
        distinct = names.groupBy("dimension").agg(F.lit("all").alias("value"), F.count(F.lit(1)).alias("n"))
    return counts.unionByName(distinct)


def apache_summary(events: DataFrame) -> DataFrame:
    """Total and counts by severity, action and raw Apache level."""
    level = F.coalesce(empty_to_null(F.try_element_at("extra", F.lit("apache_level"))), F.lit("unknown"))
    return count_by(
        events,
        {
            "total_events": F.lit("all"),
            "severity": _or_unknown("severity"),
            "event_action": _or_unknown("event_action"),
            "apache_level": level,
        },
    )


def preview(events: DataFrame, n: int) -> DataFrame:
    return events.orderBy("seq").limit(n)


# --- SSH incident report ----------------------------------------------------


def incident_counts(incidents: DataFrame) -> DataFrame:
    return count_by(
        incidents,
        {
            "total_incidents": F.lit("all"),
            "severity": F.col("severity"),
            "confidence": F.col("confidence"),
            "attack_pattern": F.col("attack_pattern"),
            "priority": F.col("priority"),
        },
    )


def session_totals(scored: DataFrame) -> DataFrame:
    """Sessions, anomalous sessions and their percentage to two places."""
    n, hit = F.count(F.lit(1)), F.count_if(F.col("is_anomalous"))
    share = F.when(n == 0, F.lit(0.0)).otherwise(rounded(F.lit(100.0) * hit / F.nullif(n, F.lit(0)), 2))
    return scored.agg(
        n.alias("total_sessions"), hit.alias("anomalous_sessions"), share.alias("anomalous_session_percent")
    )


def top_ips(incidents: DataFrame, n: int = 5) -> DataFrame:
    counts = incidents.where("ip IS NOT NULL").groupBy("ip").agg(F.count(F.lit(1)).alias("incident_count"))
    return counts.orderBy(F.desc("incident_count"), "ip").limit(n)


def top_users(clustered: DataFrame, n: int = 5) -> DataFrame:
    """Users targeted by the most incidents, from the sessions of the incidents."""
    targets = clustered.where("user IS NOT NULL").select("ip", "cluster_index", "user").distinct()
    counts = targets.groupBy("user").agg(F.count(F.lit(1)).alias("incident_count"))
    return counts.orderBy(F.desc("incident_count"), "user").limit(n)


# --- Apache sessions --------------------------------------------------------

REQUIRED_COLUMNS = [
    "session_id", "error_ratio", "apache_error_vs_notice_ratio", "apache_error_burst_max_per_minute",
    "apache_5xx_burst_max_per_minute", "apache_rare_error_message_ratio", "apache_high_severity_ratio",
    "apache_rare_hour", "error_events",
]


def missing_columns(df: DataFrame) -> list[str]:
    return [c for c in REQUIRED_COLUMNS if c not in df.columns]


def filter_apache(
    sessions: DataFrame,
    min_score: float | None = None,
    rare_hour_only: bool = False,
    min_5xx_burst: int | None = None,
    min_error_events: int | None = None,
) -> DataFrame:
    out = sessions
    if min_score is not None:
        out = out.where(F.col(score_column(sessions)) >= min_score)
    if rare_hour_only:
        out = out.where("apache_rare_hour > 0")
    if min_5xx_burst is not None:
        out = out.where(F.col("apache_5xx_burst_max_per_minute") >= min_5xx_burst)
    if min_error_events is not None:
        out = out.where(F.col("error_events") >= min_error_events)
    return out


def apache_order(df: DataFrame) -> list[Column]:
    return [F.desc(score_column(df)), *[F.asc(c) for c in ("session_id", "session_no") if c in df.columns]]


def apache_report(sessions: DataFrame, top: int, ids: int = 5) -> DataFrame:
    """Counters over the ``top`` sessions, and the ids of the first five."""
    best = sessions.orderBy(*apache_order(sessions)).limit(top)
    score = score_column(sessions)
    order_key = F.struct(-F.col(score), F.col("session_id"))
    return best.agg(
        F.count(F.lit(1)).alias("total_sessions_considered"),
        count_where(F.col("apache_rare_hour") > 0).alias("rare_hour_sessions"),
        count_where(F.col("apache_5xx_burst_max_per_minute") >= 5).alias("sessions_with_5xx_burst"),
        count_where(F.col("apache_error_burst_max_per_minute") >= 10).alias("sessions_with_error_burst"),
        count_where(F.col("apache_rare_error_message_ratio") > 0.3).alias("sessions_with_rare_templates"),
        count_where(F.col("apache_high_severity_ratio") > 0.1).alias("sessions_with_high_severity_ratio"),
        count_where(F.col("apache_error_vs_notice_ratio") > 2.0).alias("sessions_with_error_dominance"),
        F.coalesce(F.sum("error_events"), F.lit(0)).alias("total_error_events"),
        # the list is over the top rows only
        F.transform(
            F.slice(F.array_sort(F.collect_list(order_key)), 1, ids), lambda x: x["session_id"]
        ).alias("top_session_ids"),
    )


# --- model scores -----------------------------------------------------------


def score_summary(
    scored: DataFrame,
    score: str = "anomaly_score",
    threshold_percentile: float = 99.0,
    approximate: bool = False,
) -> DataFrame:
    """Minimum, maximum, mean, 95th percentile, threshold and share at or above it."""
    share_at = threshold_percentile / 100.0
    if approximate:
        p95, threshold = scored.agg(F.percentile_approx(score, [0.95, share_at], 100_000)).first()[0] or (None, None)
    elif scored.isEmpty():
        p95 = threshold = None
    else:
        p95, threshold = percentiles(scored, score, [0.95, share_at])
    above = F.count_if(F.col(score) >= F.lit(threshold).cast("double")) / F.nullif(F.count(score), F.lit(0))
    return scored.agg(
        F.min(score).alias("score_min"),
        F.max(score).alias("score_max"),
        F.avg(score).alias("score_mean"),
        F.lit(p95).cast("double").alias("score_p95"),
        F.lit(float(threshold_percentile)).alias("threshold_percentile"),
        F.lit(threshold).cast("double").alias("threshold_value"),
        above.alias("fraction_above_threshold"),
    )


def score_summaries(scored: DataFrame, run: str, score: str = "anomaly_score", threshold_percentile: float = 99.0) -> DataFrame:
    """``score_summary`` of every run, told apart by the column ``run``: one pass, however many runs."""
    values = group_percentiles(scored, run, score, [0.95, threshold_percentile / 100.0])
    summary = values.groupBy(F.col(run).alias("_run")).agg(
        F.min("value").alias("score_min"),
        F.max("value").alias("score_max"),
        (F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias("score_mean"),
        F.first("p0").alias("score_p95"),
        F.first("p1").alias("threshold_value"),
        (F.sum(F.when(F.col("value") >= F.col("p1"), F.col("n")).otherwise(0)) / F.sum("n")).alias("fraction_above_threshold"),
    )
    # Runs without any score are runs, too.
    return scored.select(run).distinct().join(summary, F.col(run).eqNullSafe(F.col("_run")), "left").select(
        run, "score_min", "score_max", "score_mean", "score_p95", F.lit(float(threshold_percentile)).alias("threshold_percentile"),
        "threshold_value", "fraction_above_threshold",
    )


def drift(runs: DataFrame) -> DataFrame:
    """Score summaries of several runs, each beside the change from the run before.

    ``runs`` has one row per run: ``run_no`` and the columns of ``score_summary``.
    """
    now, before = runs.alias("now"), runs.alias("before")
    joined = now.join(before, F.col("now.run_no") == F.col("before.run_no") + 1, "left")
    watched = ["threshold_value", "fraction_above_threshold", "score_mean"]
    return joined.select(
        F.col("now.run_no").alias("run_no"),
        *[F.col(f"now.{c}").alias(c) for c in watched],
        *[(F.col(f"now.{c}") - F.col(f"before.{c}")).alias(f"{c}_change") for c in watched],
    )
