"""Classification rules as ordered decision tables of Column conditions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from triagelens.functions.text import first_match, present, text

# Ordinal ranks and scores of the levels.
LEVEL_RANK = {"low": 1, "medium": 2, "high": 3}
PRIORITY_RANK = {"low": 1, "medium": 2, "high": 3, "critical": 4}
SEVERITY_SCORE = {"low": 25, "medium": 50, "high": 80}
CONFIDENCE_SCORE = {"low": 30, "medium": 60, "high": 85}

# Reasons given with each level, in the order they are tried.
SEVERITY_REASONS = [
    ("high", "failures followed by successful SSH login(s) with elevated anomaly score"),
    ("high", "extremely high failed-auth volume with intense automated behavior"),
    ("high", "very high failed-auth volume with elevated anomaly score"),
    ("medium", "moderate to high failed-auth volume with elevated anomaly score"),
    ("low", "limited authentication activity and anomaly score"),
]
CONFIDENCE_REASONS = [
    "successful authentication occurred after failed attempts",
    "very long consecutive failed-auth streak indicating automated guessing",
    "very high SSH event rate consistent with automated attack tooling",
    "repeated high-volume failed authentications across multiple sessions",
    "elevated anomaly score with repeated suspicious activity",
    "moderate volume of failed authentications",
    "activity repeated across multiple sessions",
    "anomaly score is elevated but supporting evidence is limited",
    "limited supporting evidence beyond the base anomaly signal",
]
PATTERN_REASONS = {
    "possible_compromise": "failed SSH authentications followed by successful login(s) for the same source IP",
    "low_signal": "low-volume failed SSH authentication activity without clear brute-force characteristics",
    "suspicious_auth_activity": (
        "SSH authentication pattern shows some suspicious characteristics but does not match a more specific pattern"
    ),
}
VOLUME_REASON = "high-volume failed SSH authentication attempts ("
SPRAY_TAIL = " distinct user(s) with no successes"
BRUTE_TAIL = " user(s) with very high failure ratio"
APACHE_PATTERNS = [
    (
        "apache_error_spike",
        "bursty Apache 4xx/5xx or error activity suggests a concentrated spike in failures",
    ),
    (
        "apache_high_severity_errors",
        "non-trivial share of crit/alert/emerg Apache events indicates elevated severity log activity",
    ),
    (
        "apache_rare_behavior",
        "rare error templates or paths suggest unusual Apache behavior that may reflect probing or misconfiguration",
    ),
    (
        "apache_rare_hour_activity",
        "Apache activity occurred during an unusual hour compared with baseline behavior",
    ),
    (
        "apache_error_dominance",
        "Apache error activity dominates notices, suggesting unhealthy or suspicious behavior",
    ),
    (
        "apache_anomalous_session",
        "Apache behavior was anomalous but did not match a more specific pattern",
    ),
]
APACHE_NOTES = [
    "high fraction of 4xx/5xx responses",
    "errors dominate over notices",
    "error spike within a single minute",
    "5xx spike within a single minute",
    "many rare error templates",
    "non-trivial share of crit/alert/emerg",
    "activity during unusual hours",
]
NO_NOTES = "no notable anomalies"


def rank_of(level: Column, ranks: dict[str, int] = LEVEL_RANK) -> Column:
    """Ordinal of a level; 0 for an unknown one."""
    table = F.create_map(*[F.lit(x) for pair in ranks.items() for x in pair])
    return F.coalesce(F.try_element_at(table, level), F.lit(0))


# --- SSH incidents ---------------------------------------------------------


def _ssh_severity_tests(score, failed, fail_ratio, mixed, streak, burst) -> list[Column]:
    return [
        mixed & (score >= 0.20) & (failed >= 20),
        (failed >= 1000) & (fail_ratio >= 0.95) & ((streak >= 200) | (burst >= 500)),
        (score >= 0.25) & (failed >= 500) & (fail_ratio >= 0.90),
        (score >= 0.15) & (failed >= 50) & (fail_ratio >= 0.70),
    ]


def ssh_severity(score, failed, fail_ratio, mixed, streak, burst) -> Column:
    tests = _ssh_severity_tests(score, failed, fail_ratio, mixed, streak, burst)
    return first_match([(t, level) for t, (level, _) in zip(tests, SEVERITY_REASONS)], SEVERITY_REASONS[-1][0])


def ssh_severity_reason(score, failed, fail_ratio, mixed, streak, burst) -> Column:
    tests = _ssh_severity_tests(score, failed, fail_ratio, mixed, streak, burst)
    return first_match([(t, why) for t, (_, why) in zip(tests, SEVERITY_REASONS)], SEVERITY_REASONS[-1][1])


def ssh_confidence(score, failed, fail_ratio, sessions, mixed, streak, burst) -> Column:
    high = (
        mixed
        | ((failed >= 100) & (sessions >= 2) & (fail_ratio >= 0.90))
        | ((score >= 0.30) & (failed >= 50) & (sessions >= 2))
        | (streak >= 200)
        | (burst >= 500)
    )
    medium = (failed >= 20) | (sessions >= 2) | (score >= 0.20) | (fail_ratio >= 0.80)
    return first_match([(high, "high"), (medium, "medium")], "low")


def ssh_confidence_reason(score, failed, fail_ratio, sessions, mixed, streak, burst) -> Column:
    tests = [
        mixed,
        streak >= 200,
        burst >= 500,
        (failed >= 100) & (sessions >= 2) & (fail_ratio >= 0.90),
        (score >= 0.30) & (failed >= 50) & (sessions >= 2),
        failed >= 20,
        sessions >= 2,
        score >= 0.20,
    ]
    return first_match(list(zip(tests, CONFIDENCE_REASONS)), CONFIDENCE_REASONS[-1])


def _ssh_pattern_tests(failed, success, fail_ratio, users, mixed) -> list[Column]:
    return [
        mixed & (success > 0),
        (failed >= 100) & (users >= 5) & (success == 0) & (fail_ratio >= 0.9),
        (failed >= 100) & (users <= 3) & (fail_ratio >= 0.9),
        (failed < 20) & (success == 0),
    ]


def ssh_pattern(failed, success, fail_ratio, users, mixed) -> Column:
    names = ["possible_compromise", "password_spray", "brute_force", "low_signal"]
    tests = _ssh_pattern_tests(failed, success, fail_ratio, users, mixed)
    return first_match(list(zip(tests, names)), "suspicious_auth_activity")


def ssh_pattern_reason(failed, success, fail_ratio, users, mixed) -> Column:
    reasons = [
        PATTERN_REASONS["possible_compromise"],
        text(VOLUME_REASON, failed, ") against ", users, SPRAY_TAIL),
        text(VOLUME_REASON, failed, ") focused on ", users, BRUTE_TAIL),
        PATTERN_REASONS["low_signal"],
    ]
    tests = _ssh_pattern_tests(failed, success, fail_ratio, users, mixed)
    return first_match(list(zip(tests, reasons)), PATTERN_REASONS["suspicious_auth_activity"])


def priority_score(severity: Column, confidence: Column) -> Column:
    """Half-even rounding: 50 x 85 / 100 = 42.5 is 42."""
    sev = F.greatest(rank_of(severity, SEVERITY_SCORE), F.lit(SEVERITY_SCORE["low"]))
    conf = F.greatest(rank_of(confidence, CONFIDENCE_SCORE), F.lit(CONFIDENCE_SCORE["low"]))
    return F.bround((sev * conf) / F.lit(100.0)).cast("bigint")


def priority_band(score: Column) -> Column:
    return first_match([(score >= 68, "critical"), (score >= 45, "high"), (score >= 20, "medium")], "low")


def priority_reason(severity: Column, confidence: Column, score: Column) -> Column:
    return text("priority derived from severity=", severity, " and confidence=", confidence, " (score=", score, ")")


def timeline_event_type(failed: Column, success: Column) -> Column:
    return first_match(
        [((success > 0) & (failed > 0), "failures_then_success"), (success > 0, "success"), (failed > 0, "failure")],
        "session",
    )


# --- Apache sessions --------------------------------------------------------


def _apache_tests(burst_5xx, burst_error, high_ratio, rare_message, rare_path, rare_hour, errors, dominance):
    return [
        (burst_5xx >= 5) | (burst_error >= 10),
        high_ratio > 0.1,
        (rare_message >= 0.3) | (rare_path >= 0.3),
        rare_hour > 0,
        (errors > 0) & (dominance > 2.0),
    ]


def apache_pattern(*values: Column) -> Column:
    """Arguments as in ``_apache_tests``: bursts, ratios, rare hour, errors, dominance."""
    rules = [(t, name) for t, (name, _) in zip(_apache_tests(*values), APACHE_PATTERNS)]
    return first_match(rules, APACHE_PATTERNS[-1][0])


def apache_pattern_reason(*values: Column) -> Column:
    rules = [(t, why) for t, (_, why) in zip(_apache_tests(*values), APACHE_PATTERNS)]
    return first_match(rules, APACHE_PATTERNS[-1][1])


def apache_severity(score, status_5xx, burst_5xx, burst_error, high_ratio) -> Column:
    medium = (burst_5xx >= 5) | (burst_error >= 10) | (high_ratio > 0.1) | ((score >= 0.20) & (status_5xx > 0))
    return F.when(medium, "medium").otherwise("low")


def apache_confidence(burst_5xx, burst_error, high_ratio, rare_message, rare_path) -> Column:
    medium = (
        (burst_5xx >= 5) | (burst_error >= 10) | (high_ratio > 0.1) | (rare_message >= 0.3) | (rare_path >= 0.3)
    )
    return F.when(medium, "medium").otherwise("low")


def apache_notes(error_ratio, dominance, burst_error, burst_5xx, rare_message, high_ratio, rare_hour) -> Column:
    tests = [
        error_ratio > 0.3,
        dominance > 2.0,
        burst_error >= 10,
        burst_5xx >= 5,
        rare_message > 0.3,
        high_ratio > 0.1,
        rare_hour > 0,
    ]
    notes = present(*[F.when(t, F.lit(note)) for t, note in zip(tests, APACHE_NOTES)])
    return F.when(F.size(notes) == 0, F.lit(NO_NOTES)).otherwise(F.array_join(notes, "; "))


# --- generic incidents ------------------------------------------------------


def generic_severity(events, errors, warnings) -> Column:
    return first_match(
        [(errors >= 5, "high"), ((errors >= 1) | (warnings >= 3) | (events >= 10), "medium")], "low"
    )


def generic_confidence(events, errors) -> Column:
    return first_match(
        [((events >= 10) | (errors >= 3), "high"), ((events >= 4) | (errors >= 1), "medium")], "low"
    )


def generic_priority(severity, confidence) -> Column:
    return first_match(
        [
            ((severity == "high") & (confidence == "high"), "critical"),
            ((severity == "high") | (confidence == "high"), "high"),
            (severity == "medium", "medium"),
        ],
        "low",
    )


def generic_pattern(errors, warnings, any_login_failed) -> Column:
    return first_match(
        [(errors >= 3, "error_spike"), (warnings >= 3, "warning_burst"), (any_login_failed, "auth_fail_burst")],
        "unknown_anomalous_behavior",
    )
