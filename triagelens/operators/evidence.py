"""Titles, descriptions, highlights, notes and evidence of incidents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triagelens.functions import rules
from triagelens.functions import wording as w
from triagelens.functions.text import fixed, iso_text, once, present, text
from triagelens.operators import generic_incidents as gen
from triagelens.operators.incidents import incident_members, timeline
from triagelens.operators.ranking import places
from triagelens.operators.sessions import SESSION
from triagelens.plans.documents import KEEP_NULLS, document_lines, json_text, opened


def _or_unknown(name: str) -> Column:
    return F.coalesce(F.nullif(F.col(name), F.lit("")), F.lit("unknown"))


def _with_default(items: Column, default: str) -> Column:
    return F.when(F.size(items) == 0, F.array(F.lit(default))).otherwise(items)


# --- SSH ---------------------------------------------------------------------


def _massive(c=F.col) -> Column:
    return (c("auth_failed") >= 100) & (c("auth_fail_ratio") >= 0.9)


def recommended_actions() -> Column:
    block, hit = _massive(), F.col("auth_success") > 0
    items = present(
        F.when(block, text(w.ACTION_BLOCK[0], _or_unknown("ip"), w.ACTION_BLOCK[1])),
        F.when(block, F.lit(w.ACTION_REVIEW)),
        F.when(hit, F.lit(w.ACTION_SUCCESS)),
        F.when(hit, F.lit(w.ACTION_RESET)),
    )
    return _with_default(items, w.ACTION_DEFAULT)


def ssh_title() -> Column:
    return text(F.initcap("severity"), " severity SSH incident from ", _or_unknown("ip"))


def _auth_phrase() -> Column:
    failed, success = F.col("auth_failed"), F.col("auth_success")
    return (
        F.when(
            (success > 0) & (failed > 0),
            text(failed, " failed and ", success, " successful SSH authentication attempts"),
        )
        .when(failed > 0, text(failed, " failed SSH authentication attempts and no successes"))
        .when(success > 0, text(success, " successful SSH authentication attempts"))
        .otherwise(w.NO_AUTH)
    )


def auth_intensity() -> Column:
    streak, burst = F.col("auth_failed_streak_max"), F.col("auth_burst_max_per_minute")
    parts = present(
        F.when(streak >= 50, text("maximum consecutive failed attempts reached ", streak, w.STREAK_TAIL)),
        F.when(burst >= 1000, text("peak SSH activity reached ", burst, w.BURST_TAIL)),
    )
    return F.when(F.size(parts) == 0, "").otherwise(
        F.concat(F.lit(" Authentication intensity: "), F.array_join(parts, " "), F.lit("."))
    )


def ssh_description() -> Column:
    c = F.col
    brute = _massive() & (c("auth_success") == 0)
    return F.concat(
        text(
            "IP ", _or_unknown("ip"), " generated ", c("total_events"), " SSH log events across ", c("session_count"),
            " session(s), with ", _auth_phrase(), ". Authentication failure ratio is ", fixed(c("auth_fail_ratio"), 2),
            " and the average anomaly score is ", fixed(c("avg_anomaly_score"), 3), ".",
        ),
        F.when(brute, w.BRUTE_FORCE_HINT).otherwise(""),
        F.when(c("has_success_after_failures"), w.COMPROMISE_HINT).otherwise(""),
        text(
            " This activity was observed between ", iso_text(c("first_seen")), " and ", iso_text(c("last_seen")), "."
        ),
        auth_intensity(),
        F.lit(" Recommended actions: "),
        F.array_join(recommended_actions(), "; "),
        F.lit("."),
    )


def local_explanation() -> Column:
    c = F.col
    parts = present(
        text(
            "This appears to be a ", c("severity"), " severity SSH incident from ", _or_unknown("ip"), ", with ",
            c("auth_failed"), " failed and ", c("auth_success"), " successful authentication attempts across ",
            c("session_count"), " session(s).",
        ),
        text("The activity occurred between ", iso_text(c("first_seen")), " and ", iso_text(c("last_seen")), "."),
        F.when(_massive(), F.lit(w.EXPLAIN_PATTERN)),
        F.concat(F.lit("Recommended next steps include: "), F.array_join(recommended_actions(), "; "), F.lit(".")),
    )
    return F.array_join(parts, " ")


def with_ssh_text(incidents: DataFrame) -> DataFrame:
    return incidents.withColumns(
        {
            "title": ssh_title(),
            "description": ssh_description(),
            "local_explanation": local_explanation(),
            "recommended_actions": recommended_actions(),
        }
    )


def ssh_session_notes() -> Column:
    failed, success = F.col("auth_failed"), F.col("auth_success")
    return present(
        F.when((failed > 0) & (success == 0), F.lit(w.NOTE_ONLY_FAILED)),
        F.when((failed > 0) & (success > 0), F.lit(w.NOTE_THEN_SUCCESS)),
        F.when(F.col("event_count") >= 100, F.lit(w.NOTE_VOLUME)),
    )


def ssh_highlights() -> Column:
    c = F.col
    items = present(
        F.when(c("has_success_after_failures"), F.lit(w.HIGHLIGHT_SUCCESS)),
        F.when(
            _massive(),
            text(
                "High volume of failed SSH authentications (", c("auth_failed"), ") with a failure ratio of ",
                fixed(c("auth_fail_ratio"), 2), ", consistent with brute-force behavior.",
            ),
        ),
        F.when(
            c("auth_failed_streak_max") >= 50,
            text("Maximum consecutive failed attempts reached ", c("auth_failed_streak_max"), "."),
        ),
        F.when(
            c("auth_burst_max_per_minute") >= 1000,
            text("Peak SSH event rate reached ", c("auth_burst_max_per_minute"), " events per minute."),
        ),
    )
    return _with_default(items, w.HIGHLIGHT_SSH_DEFAULT)


def ssh_session_evidence(clustered: DataFrame, more: list[str] | tuple = ()) -> DataFrame:
    """Evidence rows of the sessions of every incident, with ``more`` columns of the sessions."""
    rows = timeline(clustered, more)
    return rows.select(
        "incident_id",
        "session_id",
        "anomaly_score",
        iso_text(F.col("timestamp")).alias("start_time"),
        F.lit(None).cast("string").alias("end_time"),
        "ip",
        "user",
        "auth_failed",
        "auth_success",
        "event_count",
        "event_type",
        ssh_session_notes().alias("notes"),
        *more,
    )


EVIDENCE_HEAD = [
    "incident_id", "log_type", "ip", "user", "model_type", "feature_version", "threshold_percentile", "severity",
    "confidence", "priority", "attack_pattern", "highlights", "sessions", "extra",
]


def ssh_evidence_extra() -> Column:
    c = F.col
    return F.struct(
        "severity_reason", "confidence_reason", "priority_reason", "attack_pattern_reason", "auth_failed",
        "auth_success", "auth_fail_ratio", "total_events", "avg_anomaly_score", "session_count",
        "auth_failed_streak_max", "auth_burst_max_per_minute",
        iso_text(c("first_seen")).alias("first_seen"), iso_text(c("last_seen")).alias("last_seen"),
    )


def ssh_evidence(
    incidents: DataFrame,
    clustered: DataFrame,
    log_type: str = "ssh_auth",
    model_type: str = "iforest",
    threshold_percentile: float = 99.0,
) -> DataFrame:
    """One evidence row per incident, ``sessions`` holding all its session rows."""
    rows = ssh_session_evidence(clustered)
    fields = [c for c in rows.columns if c != "incident_id"]
    sessions = (
        rows.join(incidents.select("incident_id"), "incident_id", "left_semi")
        .groupBy("incident_id")
        .agg(F.array_sort(F.collect_list(F.struct("start_time", "session_id", F.struct(*fields).alias("row")))).alias("s"))
        .select("incident_id", F.transform("s", lambda x: x["row"]).alias("sessions"))
    )
    head = ssh_evidence_head(log_type, model_type, threshold_percentile)
    return incidents.join(sessions, "incident_id", "left").select(*head, "sessions", ssh_evidence_extra().alias("extra"))


def ssh_evidence_summary(
    incidents: DataFrame, log_type: str = "ssh_auth", model_type: str = "iforest", threshold_percentile: float = 99.0
) -> DataFrame:
    """The evidence rows without ``sessions``, which payloads and analyses do not read."""
    head = ssh_evidence_head(log_type, model_type, threshold_percentile)
    return incidents.select(*head, ssh_evidence_extra().alias("extra"))


def ssh_evidence_head(log_type: str, model_type: str, threshold_percentile: float) -> list[Column]:
    return [
        F.col("incident_id"),
        F.lit(log_type).alias("log_type"),
        F.col("ip"),
        F.col("primary_user").alias("user"),
        F.lit(model_type).alias("model_type"),
        F.lit(w.FEATURE_VERSION).alias("feature_version"),
        F.lit(float(threshold_percentile)).alias("threshold_percentile"),
        F.col("severity"),
        F.col("confidence"),
        F.col("priority"),
        F.col("attack_pattern"),
        ssh_highlights().alias("highlights"),
    ]


def ssh_evidence_documents(
    incidents: DataFrame,
    clustered: DataFrame,
    log_type: str = "ssh_auth",
    model_type: str = "iforest",
    threshold_percentile: float = 99.0,
) -> DataFrame:
    """The lines of one evidence document per incident, with all its sessions; see ``plans.documents``."""
    rows = ssh_session_evidence(clustered)
    entry = F.to_json(F.struct(*[c for c in rows.columns if c != "incident_id"]), KEEP_NULLS)
    # a session id may be shared by several user agents
    place = F.struct("start_time", "session_id", *SESSION)
    keyed = ssh_session_evidence(clustered, SESSION).select("incident_id", place.alias("place"), entry.alias("entry"))
    head = F.struct(*ssh_evidence_head(log_type, model_type, threshold_percentile), ssh_evidence_extra().alias("extra"))
    return document_lines(incidents.select("incident_id", opened(head).alias("opening")), {"sessions": keyed}, "incident_id")


# --- Apache ------------------------------------------------------------------


def _apache_inputs(c=F.col) -> list[Column]:
    return [
        c("apache_5xx_burst_max_per_minute"), c("apache_error_burst_max_per_minute"), c("apache_high_severity_ratio"),
        c("apache_rare_error_message_ratio"), c("apache_rare_path_ratio"), c("apache_rare_hour"), c("error_events"),
        c("apache_error_vs_notice_ratio"),
    ]


def classify_apache(sessions: DataFrame) -> DataFrame:
    """Pattern, severity, confidence and priority of each session."""
    c, inputs = F.col, _apache_inputs()
    burst_5xx, burst_error, high, rare_message, rare_path = inputs[:5]
    graded = sessions.withColumns(
        {
            "attack_pattern": rules.apache_pattern(*inputs),
            "attack_pattern_reason": rules.apache_pattern_reason(*inputs),
            "severity": rules.apache_severity(c("anomaly_score"), c("status_5xx"), burst_5xx, burst_error, high),
            "confidence": rules.apache_confidence(burst_5xx, burst_error, high, rare_message, rare_path),
        }
    )
    return graded.withColumn("priority", F.when(c("severity") == "medium", "medium").otherwise("low"))


def apache_session_notes() -> Column:
    c = F.col
    return present(
        F.when(c("status_5xx") > 0, text(c("status_5xx"), " server-error events in this session")),
        F.when(c("error_events") > 0, text(c("error_events"), " error-level Apache events")),
        F.when(
            c("apache_rare_error_message_count") > 0,
            text(c("apache_rare_error_message_count"), " rare error message template(s)"),
        ),
        F.when(c("apache_rare_hour") > 0, F.lit(w.NOTE_RARE_HOUR)),
    )


def apache_highlights() -> Column:
    """Error bursts are shown from 5 per minute on, below the 10 of the pattern."""
    burst_5xx, burst_error, _, rare_message, rare_path, rare_hour, _, _ = _apache_inputs()
    items = present(
        F.when(burst_5xx >= 5, text("5xx responses were bursty, peaking at ", burst_5xx, " per minute.")),
        F.when(burst_error >= 5, text("Apache error events were bursty, peaking at ", burst_error, " per minute.")),
        F.when(
            rare_message > 0,
            text("Rare error templates accounted for ", fixed(rare_message, 2), " of observed Apache error messages."),
        ),
        F.when(rare_path > 0, text("Rare paths accounted for ", fixed(rare_path, 2), " of distinct path activity.")),
        F.when(rare_hour > 0, F.lit(w.HIGHLIGHT_RARE_HOUR)),
    )
    return _with_default(items, w.HIGHLIGHT_APACHE_DEFAULT)


def apache_summary_notes() -> Column:
    c = F.col
    return rules.apache_notes(
        c("error_ratio"), c("apache_error_vs_notice_ratio"), c("apache_error_burst_max_per_minute"),
        c("apache_5xx_burst_max_per_minute"), c("apache_rare_error_message_ratio"), c("apache_high_severity_ratio"),
        c("apache_rare_hour"),
    )


APACHE_EXTRA = [
    "status_5xx", "error_events", "notice_events", "apache_5xx_streak_max", "apache_404_burst_max_per_minute",
    "apache_5xx_burst_max_per_minute", "apache_error_burst_max_per_minute", "apache_distinct_paths",
    "apache_rare_path_ratio", "apache_distinct_message_templates", "apache_rare_error_message_count",
    "apache_rare_error_message_ratio", "apache_rare_hour", "apache_error_vs_notice_ratio",
    "apache_high_severity_events", "apache_high_severity_ratio",
]


def apache_evidence(sessions: DataFrame, model_type: str = "iforest", threshold_percentile: float = 99.0) -> DataFrame:
    """One evidence row per session; an Apache incident is a single session."""
    graded = classify_apache(sessions)
    zero = F.lit(0).cast("bigint")
    session = F.struct(
        "session_id", "anomaly_score",
        iso_text(F.col("start_time")).alias("start_time"), iso_text(F.col("end_time")).alias("end_time"),
        "ip", "user", zero.alias("auth_failed"), zero.alias("auth_success"), "event_count",
        F.lit("apache_session").alias("event_type"), apache_session_notes().alias("notes"),
    )
    extra = F.struct(*APACHE_EXTRA, F.col("anomaly_score").alias("avg_anomaly_score"), "attack_pattern_reason")
    return graded.select(
        text("apache:", F.col("session_id")).alias("incident_id"),
        F.lit("apache_error").alias("log_type"),
        "ip",
        "user",
        F.lit(model_type).alias("model_type"),
        F.lit(w.FEATURE_VERSION).alias("feature_version"),
        F.lit(float(threshold_percentile)).alias("threshold_percentile"),
        "severity",
        "confidence",
        "priority",
        "attack_pattern",
        apache_highlights().alias("highlights"),
        F.array(session).alias("sessions"),
        extra.alias("extra"),
    )


# --- generic -----------------------------------------------------------------


def generic_highlights() -> Column:
    c = F.col
    return F.array(
        text("Grouped by key: ", c("group_key"), "."),
        text(
            "Observed ", c("event_count"), " event(s), including ", c("error_count"), " error(s) and ",
            c("warning_count"), " warning(s).",
        ),
        text(
            "Distinct entities: ", c("distinct_users"), " user(s), ", c("distinct_hosts"), " host(s), ",
            c("distinct_src_ips"), " source IP(s).",
        ),
        F.when(
            c("first_seen").isNotNull(), text("Time range: ", c("first_seen"), " to ", c("last_seen"), ".")
        ),
        text("Source type '", c("source_type"), "' grouped into pattern '", c("attack_pattern"), "'."),
    )


def generic_evidence(
    incidents: DataFrame,
    events: DataFrame,
    input_format: str = "jsonl",
    window_minutes: int = 15,
    sample: int = 5,
    mode: str = "clock",
) -> DataFrame:
    """One evidence row per incident with its first ``sample`` events; window and
    ``mode`` must be those the incidents were made with.  Incidents that were made
    with ``first_names`` bring their ip and user along."""
    c = F.col

    def session(e: Column, place: Column) -> Column:
        action = F.lower(F.coalesce(e["event_action"], F.lit("")))
        return F.struct(
            F.coalesce(e["session_hint"], text(c("incident_id"), ":event-", place + 1)).alias("session_id"),
            F.lit(0.0).alias("anomaly_score"),
            e["timestamp"].alias("start_time"),
            e["timestamp"].alias("end_time"),
            e["src_ip"].alias("ip"),
            e["user"].alias("user"),
            (action == "login_failed").cast("bigint").alias("auth_failed"),
            (action == "login_success").cast("bigint").alias("auth_success"),
            F.lit(1).cast("bigint").alias("event_count"),
            F.coalesce(e["event_action"], e["event_category"], F.lit("generic_event")).alias("event_type"),
            F.array(
                *[text(f"{name}=", F.coalesce(e[name], F.lit("unknown"))) for name in ("severity", "service", "host")]
            ).alias("notes"),
        )

    if not {"ip", "user"} <= set(incidents.columns):
        incidents = incidents.join(gen.representatives(events, window_minutes, mode), gen.GROUP, "left")
    samples = gen.sample_lists(events, sample, window_minutes, mode)
    # texts are made after the join, so they are not sent with the rows
    joined = gen.with_incident_text(incidents.join(samples, gen.GROUP, "left"))
    joined = once(joined, "shown", generic_highlights())
    extra = F.struct(
        F.lit(input_format).alias("input_format"), F.lit(window_minutes).alias("window_minutes"), "group_key",
        "source_type", c("event_count").alias("total_events"), "error_count", "warning_count", "distinct_users",
        "distinct_hosts", "distinct_src_ips", "first_seen", "last_seen", "summary_title", "summary_description",
        "sample_events",
    )
    return joined.select(
        "incident_id",
        c("source_type").alias("log_type"),
        "ip",
        "user",
        F.lit("generic").alias("model_type"),
        F.lit(w.GENERIC_FEATURE_VERSION).alias("feature_version"),
        F.lit(0.0).alias("threshold_percentile"),
        "severity",
        "confidence",
        "priority",
        "attack_pattern",
        F.filter("shown", lambda x: x.isNotNull()).alias("highlights"),
        F.transform("sample_events", session).alias("sessions"),
        extra.alias("extra"),
    )


INCIDENT_FIELDS = [
    "incident_id", "group_key", "severity", "confidence", "priority", "attack_pattern", "event_count", "error_count",
    "warning_count", "distinct_users", "distinct_hosts", "distinct_src_ips", "first_seen", "last_seen", "source_type",
]


def generic_incident_struct() -> Column:
    summary = F.struct(F.col("summary_title").alias("title"), F.col("summary_description").alias("description"))
    return F.struct(*INCIDENT_FIELDS, summary.alias("summary"))


EVENT_FIELDS = [f for f in gen.SAMPLE_FIELDS if f != "session_hint"] + ["status_code", "session_hint"]
BLOCK_EVENTS = 1000


def evidence_blocks(
    incidents: DataFrame, events: DataFrame, window_minutes: int = 15, mode: str = "clock", size: int = BLOCK_EVENTS
) -> DataFrame:
    """``incident_id, block, events``: all events of every incident in input order, ``size``
    to a row, for incidents of any number of events.

    Places are counted over ranges of all events, so no task sorts or holds a whole incident.
    """
    rows = gen.bundle(incidents, events, window_minutes, mode).select("incident_id", "seq", F.struct(*EVENT_FIELDS).alias("event"))
    dealt = places(rows, "incident_id", "seq", "place").withColumn("block", F.floor(F.col("place") / size))
    listed = dealt.groupBy("incident_id", "block").agg(F.array_sort(F.collect_list(F.struct("seq", "event"))).alias("s"))
    return listed.select("incident_id", "block", F.transform("s", lambda x: x["event"]).alias("events"))


def normalized_documents(
    incidents: DataFrame,
    events: DataFrame,
    source_type: str,
    input_format: str,
    window_minutes: int = 15,
    mode: str = "clock",
) -> DataFrame:
    """The lines of one evidence document per incident, with all its events in input order;
    see ``plans.documents``."""
    head = F.struct(
        F.lit(source_type).alias("source_type"),
        F.lit(input_format).alias("input_format"),
        F.lit(window_minutes).alias("window_minutes"),
        generic_incident_struct().alias("incident"),
        F.col("event_count").alias("total_event_count"),
    )
    entries = gen.bundle(incidents, events, window_minutes, mode).select(
        "incident_id", F.col("seq").alias("place"), F.to_json(F.struct(*EVENT_FIELDS), KEEP_NULLS).alias("entry")
    )
    return document_lines(incidents.select("incident_id", opened(head).alias("opening")), {"events": entries}, "incident_id")


def normalized_evidence(
    incidents: DataFrame,
    events: DataFrame,
    source_type: str,
    input_format: str,
    window_minutes: int = 15,
    mode: str = "clock",
) -> DataFrame:
    """Incident, its event count and all its events in input order: one row, as long as
    the incident. ``evidence_blocks`` holds the same events in rows of bounded length."""
    fields = EVENT_FIELDS
    members = gen.with_group(events, window_minutes, mode).groupBy(*gen.GROUP)
    listed = members.agg(F.array_sort(F.collect_list(F.struct("seq", F.struct(*fields).alias("event")))).alias("s"))
    return incidents.join(listed, gen.GROUP, "left").select(
        F.lit(source_type).alias("source_type"),
        F.lit(input_format).alias("input_format"),
        F.lit(window_minutes).alias("window_minutes"),
        generic_incident_struct().alias("incident"),
        F.transform("s", lambda x: x["event"]).alias("events"),
        F.col("event_count").alias("total_event_count"),
    )


# --- flat JSON shapes ----------------------------------------------------------


def incident_struct(lists: list[str]) -> Column:
    c = F.col
    return F.struct(
        "incident_id", "ip", "severity", "severity_reason", "confidence", "confidence_reason", "priority",
        "priority_score", "priority_reason", "attack_pattern", "attack_pattern_reason",
        *[f for f in lists if f == "session_ids"],
        "total_events", "avg_anomaly_score", "auth_failed", "auth_success", "auth_fail_ratio",
        iso_text(c("first_seen")).alias("first_seen"),
        iso_text(c("last_seen")).alias("last_seen"),
        "primary_user",
        *[f for f in lists if f == "targeted_users"],
    )


def incident_documents(incidents_with_text: DataFrame, clustered: DataFrame) -> DataFrame:
    """The lines of one JSON document per SSH incident, with the ids of all its sessions and all
    its users; see ``plans.documents``."""
    outer = opened(F.struct(F.struct("title", "description").alias("summary"), "local_explanation"))
    opening = F.concat(outer, F.lit('"incident":'), opened(incident_struct([])))
    members = incident_members(clustered)
    sessions = members.select(
        "incident_id", F.struct("start_time", "k_user", "k_agent", "session_id").alias("place"), json_text(F.col("session_id")).alias("entry")
    )
    users = members.where("user IS NOT NULL").select("incident_id", F.col("user").alias("place")).distinct()
    lists = {"session_ids": sessions, "targeted_users": users.withColumn("entry", json_text(F.col("place")))}
    return document_lines(incidents_with_text.select("incident_id", opening.alias("opening")), lists, "incident_id", "}}")


def incident_json(incidents_with_lists: DataFrame) -> Column:
    """JSON document of one SSH incident row (with text and member lists)."""
    incident = incident_struct([f for f in ("session_ids", "targeted_users") if f in incidents_with_lists.columns])
    summary = F.struct("title", "description")
    return F.to_json(
        F.struct(incident.alias("incident"), summary.alias("summary"), "local_explanation"), {"ignoreNullFields": "false"}
    )


SESSION_ROW = [
    "session_id", "ip", "user", "event_count", "error_ratio", "anomaly_score", "iforest_score", "iforest_score_norm",
    "ocsvm_score", "ocsvm_score_norm", "lof_score", "lof_score_norm", "ensemble_score", "anomaly_percentile",
    "is_anomalous",
]


def session_rows(scored: DataFrame) -> DataFrame:
    """The result columns of scored sessions; NaN becomes null."""
    doubles = {n for n, t in scored.dtypes if t == "double"}
    return scored.select(
        *[F.nanvl(c, F.lit(None)).alias(c) if c in doubles else F.col(c) for c in SESSION_ROW if c in scored.columns]
    )
