"""Behavioural features of sessions.

The work is laid out so that no step needs all events of an identity, a session
or a value in one task:

* sessions are numbered on one row per (identity, slice of time), and each gets one
  number, ``sid``, that stands for its four key columns in all that follows;
* ordered features (streaks, gaps, successes after a failure) are computed per
  (session, second) and the summaries are then combined along the session, as the
  summaries of two neighbouring pieces determine the summary of their union;
* peak rates use one row per (session, instant) and a copy of it in the next
  slice, since a closed window reaches back into one slice at most, summed over
  short pieces of a slice and then over the pieces;
* value rarity and distinct counts use counts per (session, value).

What a task sorts together is one second's events however many a session has.  The
events are parsed a single time: the prepared rows are written once, and once more
with their session's number, which is what the pieces of work read.  Windows name
the column with the most values first, as sorts compare it first.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from triagelens.functions.text import count_where, ratio
from triagelens.operators.sessions import (
    KEYS,
    SECOND,
    SESSION,
    identity_columns,
    number_sessions,
    session_id,
    slice_of,
    with_identity,
)
from triagelens.session import stage

RARE_SESSIONS = 3  # an identity with fewer sessions is "rarely seen"
RARE_HOURS_END = 4  # hours 0..3
ALL_PARTS = ("rates", "identity", "rarity")
RATES = ["all", "404", "5xx", "error"]  # whose peaks are taken

# The 45 numeric features, in model order.
NUMERIC_FEATURES = [
    "event_count", "duration_seconds", "status_4xx", "status_5xx", "error_ratio", "error_events", "notice_events",
    "error_event_ratio", "auth_failed", "auth_success", "auth_fail_ratio", "avg_events_per_second", "unique_paths",
    "source_count", "has_mixed_sources",
    "auth_failed_streak_max", "success_after_failure_count", "auth_burst_max_per_minute",
    "mean_inter_event_gap_seconds", "max_inter_event_gap_seconds", "ssh_distinct_users", "ssh_distinct_ips_per_user",
    "ssh_distinct_targeted_users", "ssh_rare_hour",
    "first_seen_ip_flag", "first_seen_user_flag", "rare_seen_ip_flag", "rare_seen_user_flag",
    "ip_events_per_session", "ip_events_per_session_deviation", "user_events_per_session",
    "user_events_per_session_deviation",
    "apache_5xx_streak_max", "apache_404_burst_max_per_minute", "apache_5xx_burst_max_per_minute",
    "apache_error_burst_max_per_minute", "apache_distinct_paths", "apache_rare_path_ratio",
    "apache_distinct_message_templates", "apache_rare_error_message_count", "apache_rare_error_message_ratio",
    "apache_rare_hour", "apache_error_vs_notice_ratio", "apache_high_severity_events", "apache_high_severity_ratio",
]


def _is_5xx(status: Column) -> Column:
    return status.between(500, 599)


def _prepare(events: DataFrame, slice_seconds: float) -> DataFrame:
    """Identity, slice and the columns the features read."""
    level = F.coalesce("level", "user_agent") if "level" in events.columns else F.col("user_agent")
    value = lambda name: F.col(name) if name in events.columns else F.lit(None).cast("string")
    return with_identity(events).select(
        *KEYS,
        F.unix_micros("ts").alias("us"),
        F.hour("ts").alias("hour"),
        "seq",
        "status",
        level.alias("level"),
        slice_of(F.unix_micros("ts"), slice_seconds).alias("slice"),
        slice_of(F.unix_micros("ts"), 1).alias("second"),
        value("path").alias("path"),
        value("message").alias("message"),
        value("source").alias("source"),
    )


SID = ["sid"]


def _number(rows: DataFrame, gap_minutes: float) -> DataFrame:
    """One row per (identity, slice) with its session: number within the identity, number
    among all sessions (``sid``), event count, and whether it is the session's first."""
    slices = rows.groupBy("slice", *KEYS).agg(
        F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.count(F.lit(1)).alias("n")
    )
    # sorts compare the hash first, which tells identities apart faster than their texts
    hashed = slices.withColumn("_hash", F.xxhash64(*KEYS))
    numbered = number_sessions(hashed, gap_minutes, ["slice"], ["_hash", *KEYS])
    numbered = numbered.withColumn("_row", F.monotonically_increasing_id())
    whole = W.partitionBy("_hash", *SESSION)
    return numbered.select(
        *SESSION,
        "slice",
        "is_start",
        "first_us",
        F.min("_row").over(whole).alias("sid"),
        F.sum("n").over(whole).alias("event_count"),
    )


def _piece_summaries(rows: DataFrame) -> DataFrame:
    """One row per (session, second): counts, and what is needed to join seconds."""
    order = W.partitionBy("second", *SID).orderBy("us", "seq")
    running = order.rowsBetween(W.unboundedPreceding, 0)
    status, level = F.col("status"), F.col("level")
    known = status.isNotNull()
    failed, server = status == 401, _is_5xx(status)
    flagged = rows.select(
        "second",
        *SID,
        "us",
        "seq",
        "hour",
        "status",
        "level",
        F.lag("us").over(order).alias("prev_us"),
        F.count_if(failed).over(running).alias("failed_so_far"),
        F.count_if(server).over(running).alias("server_so_far"),
    )
    # failures counted up to the last status that ended a run of failures
    ended = {
        "failed": F.when(known & (status != 401), F.col("failed_so_far")),
        "server": F.when(known & ~_is_5xx(status), F.col("server_so_far")),
    }
    with_runs = flagged.withColumns(
        {
            f"{name}_ended": end for name, end in ended.items()
        }
    ).withColumns(
        {
            f"{name}_run": F.col(f"{name}_so_far")
            - F.coalesce(
                F.max(f"{name}_ended").over(running),
                F.lit(0),
            )
            for name in ended
        }
    )
    sums = [
        F.count(F.lit(1)).alias("n"),
        F.min("us").alias("first_us"),
        F.max("us").alias("last_us"),
        F.max(F.col("us") - F.col("prev_us")).alias("gap_us"),
        count_where(status.between(400, 499)).alias("status_4xx"),
        count_where(server).alias("status_5xx"),
        count_where(failed).alias("auth_failed"),
        count_where(status == 200).alias("auth_success"),
        count_where((status == 200) & (F.col("failed_so_far") > 0)).alias("success_after"),
        count_where(level == "error").alias("error_events"),
        count_where(level == "notice").alias("notice_events"),
        count_where(level.isin("crit", "alert", "emerg")).alias("high_events"),
        count_where(F.col("hour") < RARE_HOURS_END).alias("rare_hour_events"),
    ]
    for name in ended:
        sums += [
            F.max(f"{name}_so_far").alias(f"{name}_n"),
            F.min(f"{name}_ended").alias(f"{name}_head"),
            F.max(f"{name}_ended").alias(f"{name}_last_end"),
            F.max(f"{name}_run").alias(f"{name}_best"),
        ]
    return with_runs.groupBy("second", *SID).agg(*sums)


def _moves(rows: DataFrame, width: int, by: list[str] = KEYS) -> DataFrame:
    """Arrivals (sign 1) and departures (sign -1) of events, one row per instant and sign:
    an event counts from its instant until ``width`` microseconds later, which is in the
    same slice or the next one."""
    status, level = F.col("status"), F.col("level")
    instants = rows.groupBy("us", *by, "slice").agg(
        F.count(F.lit(1)).alias("n_all"),
        count_where(status == 404).alias("n_404"),
        count_where(_is_5xx(status)).alias("n_5xx"),
        count_where(level == "error").alias("n_error"),
    )
    return instants.select(
        *by,
        F.explode(
            F.array(
                F.struct(F.col("slice").alias("at_slice"), F.col("us").alias("at"), F.lit(1).alias("sign")),
                F.struct((F.col("slice") + 1).alias("at_slice"), (F.col("us") + width + 1).alias("at"), F.lit(-1).alias("sign")),
            )
        ).alias("m"),
        *[f"n_{n}" for n in RATES],
    ).select(*by, "m.*", *[f"n_{n}" for n in RATES])


def _move_summaries(moves: DataFrame, step: int, by: list[str] = KEYS) -> DataFrame:
    """One row per (``by``, slice, ``step`` microseconds of it): the change of the number
    of events, its largest value just after an arrival, and how many events left.  The
    summaries of two neighbouring pieces determine that of their union."""
    gone = F.col("sign") < 0
    # of one instant the departures come first
    so_far = W.partitionBy("piece", *by, "at_slice").orderBy("at", "sign").rowsBetween(W.unboundedPreceding, 0)
    running = moves.withColumn("piece", F.col("at") - F.pmod("at", F.lit(step))).select(
        "*", *[F.sum(F.col("sign") * F.col(f"n_{n}")).over(so_far).alias(f"run_{n}") for n in RATES]
    )
    sums = []
    for n in RATES:
        count = F.col(f"n_{n}")
        sums += [
            F.sum(F.col("sign") * count).alias(f"net_{n}"),
            F.max(F.when(~gone, F.col(f"run_{n}"))).alias(f"best_{n}"),
            F.sum(F.when(gone, count).otherwise(0)).alias(f"gone_{n}"),
        ]
    return running.groupBy("piece", *by, "at_slice").agg(*sums)


def _peak_rates(rows: DataFrame, window_seconds: float, by: list[str] = KEYS) -> DataFrame:
    """Per (``by``, slice): the most events in any closed window ending in it.

    Slices are one window wide, so within a slice the events in the window are
    those of the slice before that have not run out plus those of the slice so
    far: a running sum over arrivals and departures.  The sum is taken in two
    steps, over pieces of a slice and then over the pieces' summaries.  A piece
    is as many microseconds long as a slice has pieces, so a task sorts some
    2 * sqrt(microseconds of a window) rows together, however dense the burst.
    """
    width = int(window_seconds * SECOND)
    pieces = _move_summaries(_moves(rows, width, by), math.isqrt(width), by)
    earlier = W.partitionBy("at_slice", *by).orderBy("piece").rowsBetween(W.unboundedPreceding, -1)
    placed = pieces.select(
        *by,
        "at_slice",
        *[f"gone_{n}" for n in RATES],
        *[(F.coalesce(F.sum(f"net_{n}").over(earlier), F.lit(0)) + F.col(f"best_{n}")).alias(f"top_{n}") for n in RATES],
    )
    # what leaves in a slice was there at its start
    peaks = placed.groupBy(F.col("at_slice").alias("slice"), *by).agg(
        *[(F.max(f"top_{n}") + F.sum(f"gone_{n}")).alias(f"peak_{n}") for n in RATES]
    )
    return peaks.where("peak_all IS NOT NULL")  # slices that hold departures only


def _join_pieces(pieces: DataFrame) -> DataFrame:
    """The run and gap values that cross seconds of a session."""
    along = W.partitionBy(*SID).orderBy("second")
    before = along.rowsBetween(W.unboundedPreceding, -1)
    upto = along.rowsBetween(W.unboundedPreceding, 0)
    out = pieces.withColumns(
        {
            "edge_gap_us": F.col("first_us") - F.lag("last_us").over(along),
            "failed_before": F.coalesce(F.sum("auth_failed").over(before), F.lit(0)),
            "failed_total": F.sum("failed_n").over(upto),
            "server_total": F.sum("server_n").over(upto),
        }
    )
    # within the session: failures counted up to the last end of a run
    out = out.withColumns(
        {f"{x}_end": F.col(f"{x}_total") - F.col(f"{x}_n") + F.col(f"{x}_last_end") for x in ("failed", "server")}
    )
    return out.withColumns(
        {
            f"{x}_longest": F.greatest(
                f"{x}_best",
                F.col(f"{x}_total")
                - F.when(F.col(f"{x}_head").isNull(), 0).otherwise(F.col(f"{x}_n") - F.col(f"{x}_head"))
                - F.coalesce(F.max(f"{x}_end").over(before), F.lit(0)),
            )
            for x in ("failed", "server")
        }
    )


def _session_sums(joined: DataFrame) -> DataFrame:
    total = lambda name: F.sum(name).cast("bigint")
    return joined.groupBy(*SID).agg(
        F.min("first_us").alias("first_us"),
        F.max("last_us").alias("last_us"),
        total("n").alias("event_count"),
        *[total(c).alias(c) for c in ("status_4xx", "status_5xx", "error_events", "notice_events",
                                      "auth_failed", "auth_success")],
        total("high_events").alias("apache_high_severity_events"),
        total("rare_hour_events").alias("rare_hour_events"),
        total(F.when(F.col("failed_before") > 0, F.col("auth_success")).otherwise(F.col("success_after"))).alias(
            "success_after_failure_count"
        ),
        F.max("failed_longest").alias("auth_failed_streak_max"),
        F.max("server_longest").alias("apache_5xx_streak_max"),
        F.max(F.greatest("gap_us", "edge_gap_us")).alias("gap_us"),
    )


def _session_peaks(rows: DataFrame, window_seconds: float) -> DataFrame:
    return _peak_rates(rows, window_seconds, SID).groupBy(*SID).agg(
        F.max("peak_all").alias("auth_burst_max_per_minute"),
        F.max("peak_404").alias("apache_404_burst_max_per_minute"),
        F.max("peak_5xx").alias("apache_5xx_burst_max_per_minute"),
        F.max("peak_error").alias("apache_error_burst_max_per_minute"),
    )


def _session_values(s: DataFrame, more: list[str]) -> DataFrame:
    """The columns of a session from its sums, its keys and ``more`` columns."""
    duration = (F.col("last_us") - F.col("first_us")) / F.lit(1e6)
    n, known_user, known_ip = F.col("event_count"), F.col("k_user") != "", F.col("k_ip") != ""
    rare_hour = (F.col("rare_hour_events") > n / 2.0).cast("bigint")
    sums = ["event_count", "status_4xx", "status_5xx", "error_events", "notice_events", "auth_failed", "auth_success",
            "apache_high_severity_events", "source_count", "success_after_failure_count", "auth_failed_streak_max",
            "apache_5xx_streak_max"]
    # the user and ip are part of the identity, so a session has one or none
    return s.select(
        *SESSION,
        session_id(F.col("k_ip"), F.col("k_user"), F.timestamp_micros("first_us")).alias("session_id"),
        *identity_columns(),
        F.timestamp_micros("first_us").alias("start_time"),
        F.timestamp_micros("last_us").alias("end_time"),
        *sums,
        *more,
        duration.alias("duration_seconds"),
        ratio(F.col("status_4xx") + F.col("status_5xx"), n).alias("error_ratio"),
        ratio(F.col("error_events"), n).alias("error_event_ratio"),
        ratio(F.col("auth_failed"), F.col("auth_failed") + F.col("auth_success")).alias("auth_fail_ratio"),
        (n / F.greatest(duration, F.lit(1.0))).alias("avg_events_per_second"),
        (F.col("source_count") > 1).cast("bigint").alias("has_mixed_sources"),
        F.when(n < 2, 0.0).otherwise(duration / (n - 1)).alias("mean_inter_event_gap_seconds"),
        F.when(n < 2, 0.0).otherwise(F.col("gap_us") / F.lit(1e6)).alias("max_inter_event_gap_seconds"),
        known_user.cast("bigint").alias("ssh_distinct_users"),
        (known_user & known_ip).cast("bigint").alias("ssh_distinct_ips_per_user"),
        known_user.cast("bigint").alias("ssh_distinct_targeted_users"),
        rare_hour.alias("ssh_rare_hour"),
        rare_hour.alias("apache_rare_hour"),
        F.when(F.col("notice_events") > 0, F.col("error_events") / F.col("notice_events"))
        .otherwise((F.col("error_events") > 0).cast("double"))
        .alias("apache_error_vs_notice_ratio"),
        ratio(F.col("apache_high_severity_events"), n).alias("apache_high_severity_ratio"),
    )


def _value_counts(rows: DataFrame, facets: list[str]) -> DataFrame:
    """Per session and facet (path, message, source): distinct values, their events, and
    the values seen once in all data.

    A value seen once belongs to the one session that has it, so rarity needs
    the values' total counts but no join of events with them.
    """
    named = F.explode(F.array(*[F.struct(F.lit(f).alias("facet"), F.col(f).alias("value")) for f in facets]))
    values = rows.select(*SID, named.alias("f")).select(*SID, "f.facet", "f.value").where("value <> '' AND sid IS NOT NULL")
    # used twice, made once: the plan reuses its exchange
    per_session = values.groupBy("value", *SID, "facet").agg(F.count(F.lit(1)).alias("n"))
    once = per_session.groupBy("value", "facet").agg(F.sum("n").alias("n"), F.min("sid").alias("sid")).where("n = 1")
    none = F.lit(0).cast("bigint")
    found = per_session.select(*SID, "facet", F.lit(1).alias("distinct"), "n", none.alias("rare")).union(
        once.select(*SID, "facet", none, none, "n")
    )
    of = lambda name, facet: F.sum(F.when(F.col("facet") == facet, F.col(name)).otherwise(0))
    return found.groupBy(*SID).agg(
        *[of(name, f).cast("bigint").alias(f"{f}_{name}") for f in facets for name in ("distinct", "n", "rare")]
    )


def identity_baseline(sessions: DataFrame, column: str) -> DataFrame:
    """Sessions, events, first start and mean events per session of each value."""
    return (
        sessions.where(F.col(column).isNotNull())
        .groupBy(column)
        .agg(
            F.count(F.lit(1)).alias("session_count"),
            F.sum("event_count").alias("event_total"),
            F.min("start_time").alias("first_seen"),
        )
        .withColumn("events_per_session", F.col("event_total") / F.col("session_count"))
    )


def _spread(column: str) -> Column:
    """Join key whose nulls, which match nothing, do not all go to one task."""
    salt = F.pmod(F.xxhash64(*SESSION), F.lit(4096)).cast("string")
    return F.coalesce(F.col(column), F.concat(F.lit("\x01"), salt))


def with_identity_baselines(sessions: DataFrame) -> DataFrame:
    """First-seen and rarely-seen flags, baseline and deviation, by ip and user."""
    out = sessions
    for column in ("ip", "user"):
        known = F.col(column).isNotNull()
        base = identity_baseline(sessions, column).select(
            F.col(column).alias("_key"),
            F.col("session_count").alias("_sessions"),
            F.col("first_seen").alias("_first"),
            F.col("events_per_session").alias("_mean"),
        )
        out = (
            out.withColumn("_key", _spread(column))
            .join(base, "_key", "left")
            .withColumns(
                {
                    f"first_seen_{column}_flag": (known & (F.col("start_time") == F.col("_first"))).cast("bigint"),
                    f"rare_seen_{column}_flag": (known & (F.col("_sessions") < RARE_SESSIONS)).cast("bigint"),
                    f"{column}_events_per_session": F.coalesce("_mean", F.lit(0.0)),
                    f"{column}_events_per_session_deviation": F.coalesce(
                        F.col("event_count") - F.col("_mean"), F.lit(0.0)
                    ),
                }
            )
            .withColumns(
                {c: F.coalesce(c, F.lit(0)) for c in (f"first_seen_{column}_flag", f"rare_seen_{column}_flag")}
            )
            .drop("_key", "_sessions", "_first", "_mean")
        )
    return out


def session_features(
    events: DataFrame,
    gap_minutes: float = 30,
    window_seconds: float = 60,
    parts=ALL_PARTS,
) -> DataFrame:
    """One row per session with the features of the chosen ``parts``.

    Base and ordered features are always there; ``rates`` adds peak rates,
    ``identity`` the per-ip and per-user baselines, ``rarity`` the path and
    message features.  All parts together give every name of
    ``NUMERIC_FEATURES``.
    """
    if window_seconds > gap_minutes * 60:
        raise ValueError("the rate window must not be longer than the session gap")
    prepared = stage(_prepare(events, window_seconds), "prepared")
    numbered = stage(_number(prepared, gap_minutes), "numbered")
    place = ["slice", *KEYS]
    rows = stage(prepared.join(numbered.select(*place, *SID), place).drop(*KEYS), "rows")

    sessions = numbered.where("is_start").select(
        *SID, *SESSION, *identity_columns(), F.timestamp_micros("first_us").alias("start_time"), "event_count"
    )
    more = []
    if "identity" in parts:
        sessions = with_identity_baselines(sessions)
        more += [c for c in sessions.columns if c.endswith(("_flag", "_per_session", "_deviation"))]
    out = _session_sums(_join_pieces(_piece_summaries(rows))).join(sessions.select(*SID, *SESSION, *more), SID)
    if "rates" in parts:
        peaks = _session_peaks(rows, window_seconds)
        out, more = out.join(peaks, SID), more + [c for c in peaks.columns if c not in SID]
    facets = ["source", "path", "message"] if "rarity" in parts else ["source"]
    out = out.join(_value_counts(rows, facets), SID, "left")
    zero = lambda name: F.coalesce(F.col(name), F.lit(0))
    out = out.withColumn("source_count", zero("source_distinct"))
    if "rarity" in parts:
        rarity = {
            "apache_distinct_paths": zero("path_distinct"),
            "unique_paths": zero("path_distinct"),
            "apache_distinct_message_templates": zero("message_distinct"),
            "apache_rare_error_message_count": zero("message_rare"),
            "apache_rare_path_ratio": ratio(zero("path_rare"), zero("path_n")),
            "apache_rare_error_message_ratio": ratio(zero("message_rare"), zero("message_n")),
        }
        out, more = out.withColumns(rarity), more + list(rarity)
    return _session_values(out, more)
