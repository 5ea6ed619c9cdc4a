"""Incidents of normalized events: one per group key and clock bucket."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from triagelens.functions import rules
from triagelens.functions.text import blank_to_null, count_where, empty_to_null, once, text
from triagelens.operators.ranking import numbered

GROUP = ["group_key", "bucket"]
WINDOW_RANGE = (1, 1440)
TOP_RANGE = (1, 100)


def check_window(minutes: int) -> None:
    if not WINDOW_RANGE[0] <= minutes <= WINDOW_RANGE[1]:
        raise ValueError(f"window_minutes must be in {WINDOW_RANGE[0]}..{WINDOW_RANGE[1]}")


def check_top(top: int) -> None:
    if not TOP_RANGE[0] <= top <= TOP_RANGE[1]:
        raise ValueError(f"top must be in {TOP_RANGE[0]}..{TOP_RANGE[1]}")


def group_key() -> Column:
    """The most specific identity an event has."""
    c = {n: empty_to_null(F.col(n)) for n in ("session_hint", "src_ip", "user", "host", "service")}
    hint, ip, user, host, service = c.values()
    return F.coalesce(
        F.concat(F.lit("session_hint:"), hint),
        F.concat(F.lit("src_ip_user:"), ip, F.lit("|"), user),
        F.concat(F.lit("src_ip:"), ip),
        F.concat(F.lit("user:"), user),
        F.concat(F.lit("host_service:"), host, F.lit("|"), service),
        F.concat(F.lit("host:"), host),
        F.concat(F.lit("service:"), service),
        F.lit("unknown"),
    )


def clock_bucket(minutes: int) -> Column:
    """Start of the event's bucket as text in the event's own zone.

    Minutes are floored within the hour, so buckets longer than an hour are one
    hour and a width that does not divide 60 starts anew each hour.
    """
    iso = F.col("timestamp")
    minute = F.substring(iso, 15, 2).try_cast("int")
    floored = F.lpad((minute - minute % minutes).cast("string"), 2, "0")
    zone = F.regexp_extract(iso, r"([+-]\d{2}:\d{2})$", 1)
    return F.when(
        F.col("event_ts").isNotNull(), F.concat(F.substring(iso, 1, 14), floored, F.lit(":00"), zone)
    ).otherwise("no_time")


def with_group(events: DataFrame, window_minutes: int = 15, mode: str = "clock") -> DataFrame:
    """Adds the group. Events that have it keep it; window and ``mode`` must be those it was made with."""
    check_window(window_minutes)
    if set(GROUP) <= set(events.columns):
        return events
    if mode == "clock":
        return events.withColumns({"group_key": group_key(), "bucket": clock_bucket(window_minutes)})
    start = F.floor(F.unix_seconds("event_ts") / (window_minutes * 60)) * (window_minutes * 60)
    bucket = F.coalesce(F.date_format(F.timestamp_seconds(start), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("no_time"))
    return events.withColumns({"group_key": group_key(), "bucket": bucket})


def group_counts() -> list[Column]:
    level, action = F.lower("severity"), F.lower("event_action")
    at = F.col("event_ts")
    return [
        F.count(F.lit(1)).alias("event_count"),
        count_where(level == "error").alias("error_count"),
        count_where(level.isin("warn", "warning")).alias("warning_count"),
        F.coalesce(F.bool_or(action == "login_failed"), F.lit(False)).alias("any_login_failed"),
        F.min_by("timestamp", F.when(at.isNotNull(), F.struct(at, "timestamp"))).alias("first_seen"),
        F.max_by("timestamp", F.when(at.isNotNull(), F.struct(at, "timestamp"))).alias("last_seen"),
        F.min_by("source_type", "seq").alias("source_type"),
    ]


def first_names() -> list[Column]:
    """First non-empty ip and user of a group, in input order."""
    ip, user = empty_to_null(F.col("src_ip")), empty_to_null(F.col("user"))
    return [
        F.min_by(ip, F.when(ip.isNotNull(), F.col("seq"))).alias("ip"),
        F.min_by(user, F.when(user.isNotNull(), F.col("seq"))).alias("user"),
    ]


ENTITIES = {"user": "distinct_users", "host": "distinct_hosts", "src_ip": "distinct_src_ips"}


def entity_sets(grouped: DataFrame) -> DataFrame:
    """Distinct users, hosts and source ips of each group, one row each."""
    names = F.array(*[F.struct(F.lit(c).alias("kind"), blank_to_null(F.col(c)).alias("name")) for c in ENTITIES])
    return (
        grouped.select(*GROUP, F.explode(names).alias("e"))
        .select(*GROUP, "e.kind", "e.name")
        .where("name IS NOT NULL")
        .distinct()
    )


def generic_groups(grouped: DataFrame, more: list[Column] | tuple = ()) -> DataFrame:
    """Counts per group, and ``more`` aggregates.  The distinct entities are counted from one
    row per (group, kind, entity), so a large group is spread over its entities."""
    base = grouped.groupBy(*GROUP).agg(*group_counts(), *more)
    entities = entity_sets(grouped).groupBy(*GROUP).agg(
        *[count_where(F.col("kind") == kind).alias(name) for kind, name in ENTITIES.items()]
    )
    return base.join(entities, GROUP, "left").withColumns(
        {name: F.coalesce(name, F.lit(0)) for name in ENTITIES.values()}
    )


def classify_generic(groups: DataFrame) -> DataFrame:
    n, errors, warnings = F.col("event_count"), F.col("error_count"), F.col("warning_count")
    graded = once(groups, "severity", rules.generic_severity(n, errors, warnings))
    graded = once(graded, "confidence", rules.generic_confidence(n, errors))
    return graded.withColumns(
        {
            "attack_pattern": rules.generic_pattern(errors, warnings, F.col("any_login_failed")),
            "priority": rules.generic_priority(F.col("severity"), F.col("confidence")),
        }
    )


def summary_title() -> Column:
    return text(F.initcap("severity"), " generic incident for ", F.col("group_key"))


def summary_description() -> Column:
    c = F.col
    return text(
        "Grouped ", c("event_count"), " event(s) for ", c("group_key"), " between ",
        F.coalesce("first_seen", F.lit("unknown")), " and ", F.coalesce("last_seen", F.lit("unknown")),
        ", with ", c("error_count"), " error event(s), ", c("warning_count"), " warning event(s), across ",
        c("distinct_users"), " user(s), ", c("distinct_hosts"), " host(s), and ", c("distinct_src_ips"),
        " source IP(s). Detected pattern: ", c("attack_pattern"), ".",
    )


def number_incidents(groups: DataFrame, ranges: int | None = None) -> DataFrame:
    """1-based ``incident_index`` in the text order of key and bucket."""
    bucket_id = text(F.col("group_key"), "||", F.col("bucket"))
    return numbered(groups, bucket_id, "incident_index", ranges).withColumn("bucket_id", bucket_id)


def generic_incidents(
    events: DataFrame, window_minutes: int = 15, mode: str = "clock", more: list[Column] | tuple = ()
) -> DataFrame:
    """Classified and numbered incidents, not ordered; see ``generic_order``.

    They are written as they are numbered, so reading them again does not run the job again.
    ``more`` are further aggregates of the events of an incident, such as ``first_names``.
    """
    graded = classify_generic(generic_groups(with_group(events, window_minutes, mode), more))
    return with_incident_text(number_incidents(graded))


def with_incident_text(numbered_groups: DataFrame) -> DataFrame:
    """Id, title and description, which follow from the other columns."""
    return numbered_groups.withColumns(
        {
            "incident_id": text("generic:", F.col("group_key"), "#", F.col("incident_index")),
            "summary_title": summary_title(),
            "summary_description": summary_description(),
        }
    )


def generic_order() -> list[Column]:
    return [
        rules.rank_of(F.col("priority"), rules.PRIORITY_RANK).desc(),
        rules.rank_of(F.col("severity")).desc(),
        F.desc("event_count"),
        F.desc("error_count"),
        F.asc("bucket_id"),
    ]


def bundle(incidents: DataFrame, events: DataFrame, window_minutes: int = 15, mode: str = "clock") -> DataFrame:
    """Every event with the id of its incident: the whole membership as rows."""
    keys = incidents.select(*GROUP, "incident_id")
    return with_group(events, window_minutes, mode).join(keys, GROUP)


SAMPLE_FIELDS = [
    "timestamp", "event_category", "event_action", "severity", "src_ip", "dst_ip", "user", "host", "service",
    "message", "session_hint",
]


def first_events(events: DataFrame, n: int, window_minutes: int = 15, mode: str = "clock") -> DataFrame:
    """The first ``n`` events of each group in input order, with ``position``.

    The rank filter is applied before the shuffle as well, so a large group
    sends at most ``n`` rows per task.
    """
    order = W.partitionBy(*GROUP).orderBy("seq")
    ranked = with_group(events, window_minutes, mode).withColumn("position", F.row_number().over(order))
    return ranked.where(F.col("position") <= n)


def sample_lists(events: DataFrame, n: int, window_minutes: int = 15, mode: str = "clock") -> DataFrame:
    """``sample_events``: the first ``n`` events of each group in input order, one row per group.

    They are listed in the order of the rank, without another sort; a list has at most ``n`` events.
    """
    following = W.partitionBy(*GROUP).orderBy("seq").rowsBetween(W.currentRow, n - 1)
    first = first_events(events, n, window_minutes, mode).select(*GROUP, "seq", "position", F.struct(*SAMPLE_FIELDS).alias("event"))
    listed = first.withColumn("sample_events", F.collect_list("event").over(following))
    return listed.where("position = 1").select(*GROUP, "sample_events")


def representatives(events: DataFrame, window_minutes: int = 15, mode: str = "clock") -> DataFrame:
    """First non-empty ip and user of each group, in input order."""
    return with_group(events, window_minutes, mode).groupBy(*GROUP).agg(*first_names())
