"""Playbooks, rule-based analysis, prompt payloads and payload checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from triagelens.functions import wording as w
from triagelens.functions.text import first_match, fixed, iso_text, present, text

PLAYBOOK_SCHEMA = (
    "attack_pattern string, severity string, slug string, title string, description string, next_steps array<string>"
)


def playbooks(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(w.PLAYBOOKS, PLAYBOOK_SCHEMA)


def with_playbook(incidents: DataFrame) -> DataFrame:
    """Adds struct ``playbook``: that of (pattern, severity), else of (pattern,
    medium), else null.  The table has five rows, so it is broadcast."""
    books = playbooks(incidents.sparkSession)
    book = F.struct("slug", "title", "description", "next_steps")
    exact = F.broadcast(books.select("attack_pattern", "severity", book.alias("_exact")))
    medium = F.broadcast(books.where("severity = 'medium'").select("attack_pattern", book.alias("_medium")))
    return (
        incidents.join(exact, ["attack_pattern", "severity"], "left")
        .join(medium, "attack_pattern", "left")
        .withColumn("playbook", F.coalesce("_exact", "_medium"))
        .drop("_exact", "_medium")
    )


# --- payloads ------------------------------------------------------------------


def _payload(incident: Column, evidence: Column, line: Column, aggregates: Column) -> Column:
    return F.struct(
        incident.alias("incident"),
        evidence.alias("evidence"),
        line.alias("timeline_summary"),
        aggregates.alias("aggregates"),
    )


def _line(what: str) -> Column:
    c = F.col
    return text(what, c("incident_id"), " with attack pattern '", c("attack_pattern"), "' and severity ", c("severity"), ".")


def _head() -> list:
    return ["incident_id", "ip", "severity", "attack_pattern", F.col("user").alias("primary_user")]


def ssh_payload() -> Column:
    """Payload column over ``ssh_evidence`` rows."""
    extra = [
        "total_events", "avg_anomaly_score", "auth_failed", "auth_success", "auth_fail_ratio",
        "auth_failed_streak_max", "auth_burst_max_per_minute", "first_seen", "last_seen",
    ]
    return _payload(
        F.struct(*_head(), *[F.col(f"extra.{x}") for x in extra]),
        F.struct("highlights"),
        _line("SSH incident "),
        F.struct(F.lit(1).alias("total_incidents")),
    )


def apache_payload() -> Column:
    extra = [
        "status_5xx", "apache_5xx_burst_max_per_minute", "apache_error_burst_max_per_minute",
        "apache_rare_error_message_ratio", "apache_rare_path_ratio", "apache_high_severity_ratio",
    ]
    return _payload(
        F.struct(
            *_head(), F.col("extra.error_events").alias("total_events"), F.col("extra.avg_anomaly_score"),
            *[F.col(f"extra.{x}") for x in extra],
        ),
        F.struct("highlights"),
        _line("Apache error session "),
        F.struct(F.lit(1).alias("total_incidents")),
    )


def generic_payload() -> Column:
    extra = [
        "total_events", "error_count", "warning_count", "distinct_users", "distinct_hosts", "distinct_src_ips",
        "group_key", "source_type", "first_seen", "last_seen", "summary_title", "summary_description",
    ]
    c = F.col
    line = text(
        "Generic incident ", c("incident_id"), " for log_type '", c("log_type"), "' with attack pattern '",
        c("attack_pattern"), "' and severity ", c("severity"), ".",
    )
    return _payload(
        F.struct(*_head(), *[F.col(f"extra.{x}") for x in extra]),
        F.struct("highlights", F.col("extra.sample_events").alias("sample_events")),
        line,
        F.struct(F.lit(1).alias("total_incidents"), F.col("extra.input_format"), F.col("extra.window_minutes")),
    )


def structured_payload(first: int = 20) -> Column:
    """Payload column over ``normalized_evidence`` rows."""
    guide = F.struct(
        F.lit("Explain this group of log events from the normalized evidence given here.").alias("task"),
        F.struct(*[F.lit(w.RESPONSE_SHAPE[k]).alias(k) for k in w.ANALYSIS_KEYS]).alias("response_format"),
        F.array(
            F.lit("Rely on the given evidence alone."),
            F.lit("Keep it short and useful to the person on call."),
            F.lit("Say so where the evidence is thin, and do not assert a compromise it does not show."),
        ).alias("rules"),
    )
    sample = F.slice("events", 1, first)
    return F.struct(
        "source_type", "input_format", "window_minutes", "incident", "events", sample.alias("events_sample"),
        F.size(sample).alias("sampled_event_count"), "total_event_count", guide.alias("instructions"),
    )


def payload_json(payload: Column) -> Column:
    return F.to_json(payload, {"ignoreNullFields": "false"})


def text_prompt() -> Column:
    """Plain-text briefing for one SSH incident row with title and description."""
    c = F.col
    facts = [
        ("Incident ID", c("incident_id")),
        ("Source IP", F.coalesce("ip", F.lit("unknown"))),
        ("Severity", c("severity")),
        ("Total SSH log events", c("total_events")),
        ("Number of SSH sessions", c("session_count")),
        ("Failed authentication attempts", c("auth_failed")),
        ("Successful authentication attempts", c("auth_success")),
        ("Authentication failure ratio", fixed(c("auth_fail_ratio"), 2)),
        ("Average anomaly score", fixed(c("avg_anomaly_score"), 3)),
        ("First seen", iso_text(c("first_seen"))),
        ("Last seen", iso_text(c("last_seen"))),
    ]
    lines = [F.lit("A suspicious SSH incident needs an analyst's reading. What is known:")]
    lines += [text("- ", name, ": ", value) for name, value in facts]
    lines += [
        F.lit("Actions proposed by rule:"),
        F.array_join(F.transform("recommended_actions", lambda a: F.concat(F.lit("- "), a)), "\n"),
        text("Title: ", c("title")),
        text("Description: ", c("description")),
        F.lit(
            "Say in two or three sentences what is going on, whether it looks like brute force or password "
            "spraying, and name one or two next steps."
        ),
    ]
    return F.concat_ws("\n", *lines)


# --- rule-based analysis ----------------------------------------------------------


def _field(names: set[str], name: str) -> Column | None:
    return F.col(f"payload.incident.{name}") if name in names else None


def _summary() -> Column:
    i = "payload.incident."
    return F.concat(
        text(
            "This incident involves activity associated with ",
            F.coalesce(F.col(i + "primary_user"), F.lit("unknown user")), " from ",
            F.coalesce(F.col(i + "ip"), F.lit("unknown IP")), ", classified as ", F.col(i + "severity"),
            " severity with attack pattern '", F.col(i + "attack_pattern"), "'.",
        ),
        F.when(
            F.col("playbook").isNotNull(),
            text(" It aligns most closely with the playbook '", F.col("playbook.title"), "'."),
        ).otherwise(""),
        F.lit(" "),
        F.col("payload.timeline_summary"),
    )


def _bullets(names: set[str], evidence: set[str]) -> Column:
    f = lambda name: _field(names, name)
    items = []
    if "total_events" in names:
        items.append(text("Total events in this incident: ", f("total_events"), "."))
    if "auth_failed" in names:
        items += [
            text(
                "Observed ", f("auth_failed"), " failed and ", f("auth_success"),
                " successful SSH authentication attempts.",
            ),
            text("Authentication failure ratio is approximately ", fixed(f("auth_fail_ratio"), 2), "."),
            F.when(
                f("auth_failed_streak_max") > 0,
                text("Maximum consecutive failed logins: ", f("auth_failed_streak_max"), "."),
            ),
            F.when(
                f("auth_burst_max_per_minute") > 0,
                text(
                    "Maximum failed-login burst in a one-minute window: ", f("auth_burst_max_per_minute"), " events."
                ),
            ),
        ]
    if "error_count" in names:
        items += [
            text(
                "Generic incident counts include ", f("error_count"), " error event(s) and ", f("warning_count"),
                " warning event(s).",
            ),
            text(
                "Distinct entities observed: ", f("distinct_users"), " user(s), ", f("distinct_hosts"),
                " host(s), and ", f("distinct_src_ips"), " source IP(s).",
            ),
        ]
    if "first_seen" in names:
        either = f("first_seen").isNotNull() | f("last_seen").isNotNull()
        known = [F.coalesce(f(n), F.lit("unknown")) for n in ("first_seen", "last_seen")]
        items.append(F.when(either, text("Observed time range: ", known[0], " to ", known[1], ".")))
    if "source_type" in names:
        items += [text("Source type: ", f("source_type"), "."), text("Grouping key: ", f("group_key"), ".")]
    highlights = F.col("payload.evidence.highlights")
    shown = F.transform(F.slice(highlights, 1, 3), lambda h: F.concat(F.lit("- "), h))
    parts = [present(*items), F.when(F.size(highlights) > 0, F.concat(F.array(F.lit("Evidence highlights:")), shown))]
    if "sample_events" in evidence:
        n = F.size("payload.evidence.sample_events")
        parts.append(
            F.when(n > 0, F.array(text("Sample normalized events included: ", F.least(n, F.lit(5)), ".")))
        )
    none = F.array().cast("array<string>")
    return F.concat(*[F.coalesce(p, none) for p in parts])


def _hypothesis() -> Column:
    pattern = F.col("payload.incident.attack_pattern")
    by_pattern = first_match([(pattern == p, h) for p, h in w.HYPOTHESES.items()], w.HYPOTHESIS_DEFAULT)
    from_book = text(
        "The activity is most consistent with '", F.col("playbook.title"), "', suggesting ",
        F.lower("playbook.description"),
    )
    return F.when(F.col("playbook").isNotNull(), from_book).otherwise(by_pattern)


def _caveats(names: set[str]) -> Column:
    items = [
        F.when(F.col("payload.aggregates.total_incidents") < 3, F.lit(w.CAVEAT_VOLUME)),
        F.when(F.col("payload.incident.ip").isNull(), F.lit(w.CAVEAT_IP)),
        F.when(F.col("payload.incident.primary_user").isNull(), F.lit(w.CAVEAT_USER)),
    ]
    if "source_type" in names:
        source = F.col("payload.incident.source_type")
        items.append(F.when(~source.isin("ssh_auth", "apache_error"), F.lit(w.CAVEAT_GENERIC)))
    return present(*items, F.lit(w.CAVEAT_SCOPE))


def analyse(evidence: DataFrame, payload: Column) -> DataFrame:
    """The seven analysis columns for each evidence row, by rule."""
    rows = with_playbook(evidence.withColumn("payload", payload))
    fields = {f.name: f.dataType for f in rows.schema["payload"].dataType.fields}
    names, inside = set(fields["incident"].names), set(fields["evidence"].names)
    generic_steps = F.array(*[F.lit(s) for s in w.GENERIC_STEPS])
    return rows.select(
        "incident_id",
        _summary().alias("summary"),
        _bullets(names, inside).alias("evidence"),
        _hypothesis().alias("hypothesis"),
        _caveats(names).alias("caveats"),
        F.coalesce("playbook.next_steps", generic_steps).alias("next_steps"),
        F.col("playbook.slug").alias("playbook_slug"),
        F.coalesce("playbook.description", F.lit(w.NO_PLAYBOOK)).alias("playbook_notes"),
    )


# --- payload checks -----------------------------------------------------------------


def check_analysis(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """Adds ``problem``: why a JSON analysis is not usable, null if it is."""
    doc = F.try_parse_json(F.col(column))
    typed = payloads.withColumn("_doc", doc).withColumn(
        "_map", F.expr("try_variant_get(_doc, '$', 'map<string,variant>')")
    )
    kind = lambda key: F.schema_of_variant(F.try_element_at("_map", F.lit(key)))
    checks = [(F.col("_map").isNull(), F.lit("AI analysis must be a dict."))]
    checks += [
        (
            ~F.map_contains_key("_map", key),
            F.lit(f"AI analysis is missing required key: '{key}'"),
        )
        for key in w.ANALYSIS_KEYS
    ]
    for key in ("summary", "evidence", "hypothesis", "caveats", "next_steps"):
        if key in ("summary", "hypothesis"):
            checks.append((kind(key) != "STRING", F.lit(f"AI analysis '{key}' must be a string.")))
        else:
            listed = kind(key).startswith("ARRAY")
            checks += [
                (~listed, F.lit(f"AI analysis '{key}' must be a list of strings.")),
                (
                    ~(_all_text(key)),
                    F.lit(f"AI analysis '{key}' must contain only strings."),
                ),
            ]
    for key in ("playbook_slug", "playbook_notes"):
        checks.append((~kind(key).isin("STRING", "VOID"), F.lit(f"AI analysis '{key}' must be a string or None.")))
    problem = F.when(*checks[0])
    for condition, why in checks[1:]:
        problem = problem.when(condition, why)
    return typed.withColumn("problem", problem).drop("_doc", "_map")


def _all_text(key: str) -> Column:
    items = F.expr(f"try_variant_get(_doc, '$.{key}', 'array<variant>')")
    return F.forall(F.coalesce(items, F.array().cast("array<variant>")), lambda v: F.schema_of_variant(v) == "STRING")
