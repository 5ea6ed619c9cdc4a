"""DuckDB statements for scores, SSH incidents and what is built on them."""

from __future__ import annotations

from triagelens.functions import rules as r
from triagelens.oracle import views as v

SCORED = """
scored AS (SELECT *, 0.3::DOUBLE * auth_fail_ratio + 0.05::DOUBLE * least(event_count, 10) / 10 AS anomaly_score FROM feats)
"""


def threshold_view(percentile: float = 95.0) -> str:
    return f"""
ranked AS (
  SELECT *, percentile >= {percentile} AS is_anomalous FROM (
    SELECT *, (rank() OVER (ORDER BY anomaly_score) - 1
      + (count(*) OVER (PARTITION BY anomaly_score) + 1) / 2.0::DOUBLE) / count(*) OVER () * 100.0::DOUBLE AS percentile
    FROM scored))
"""


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


MERGED = """
merge_marks AS (
  SELECT *, CASE WHEN epoch_us(start_time) - epoch_us(lag(end_time) OVER w) > 3600000000 THEN 1 ELSE 0 END AS opens
  FROM {source} WHERE ip IS NOT NULL AND ip <> '' WINDOW w AS (PARTITION BY ip ORDER BY start_time, k_user)),
clustered AS (
  SELECT *, sum(opens) OVER (PARTITION BY ip ORDER BY start_time, k_user ROWS UNBOUNDED PRECEDING)::BIGINT AS cluster_index
  FROM merge_marks)
"""

_S, _F, _R, _K, _B, _X, _N = "avg_anomaly_score auth_failed auth_fail_ratio auth_failed_streak_max auth_burst_max_per_minute has_success_after_failures session_count".split()

_SEVERITY = [
    f"{_X} AND {_S} >= 0.20::DOUBLE AND {_F} >= 20",
    f"{_F} >= 1000 AND {_R} >= 0.95::DOUBLE AND ({_K} >= 200 OR {_B} >= 500)",
    f"{_S} >= 0.25::DOUBLE AND {_F} >= 500 AND {_R} >= 0.90::DOUBLE",
    f"{_S} >= 0.15::DOUBLE AND {_F} >= 50 AND {_R} >= 0.70::DOUBLE",
]
_CONFIDENCE = [
    _X,
    f"{_K} >= 200",
    f"{_B} >= 500",
    f"{_F} >= 100 AND {_N} >= 2 AND {_R} >= 0.90::DOUBLE",
    f"{_S} >= 0.30::DOUBLE AND {_F} >= 50 AND {_N} >= 2",
    f"{_F} >= 20",
    f"{_N} >= 2",
    f"{_S} >= 0.20::DOUBLE",
]


def case(tests: list[str], values: list[str]) -> str:
    body = " ".join(f"WHEN {t} THEN {x}" for t, x in zip(tests, values))
    return f"CASE {body} ELSE {values[-1]} END"


def incident_views(source: str = "scored", min_sessions: int = 1, base: list[str] | None = None, more: str = "") -> list[str]:
    pattern_tests = [
        f"{_X} AND auth_success > 0",
        f"{_F} >= 100 AND distinct_users >= 5 AND auth_success = 0 AND {_R} >= 0.9::DOUBLE",
        f"{_F} >= 100 AND distinct_users <= 3 AND {_R} >= 0.9::DOUBLE",
        f"{_F} < 20 AND auth_success = 0",
    ]
    pattern_names = ["possible_compromise", "password_spray", "brute_force", "low_signal", "suspicious_auth_activity"]
    pattern_reasons = [
        q(r.PATTERN_REASONS["possible_compromise"]),
        f"{q(r.VOLUME_REASON)} || {_F} || ') against ' || distinct_users || {q(r.SPRAY_TAIL)}",
        f"{q(r.VOLUME_REASON)} || {_F} || ') focused on ' || distinct_users || {q(r.BRUTE_TAIL)}",
        q(r.PATTERN_REASONS["low_signal"]),
        q(r.PATTERN_REASONS["suspicious_auth_activity"]),
    ]
    users = """
user_mode AS (
  SELECT ip, cluster_index, "user" AS primary_user FROM (
    SELECT ip, cluster_index, "user",
      row_number() OVER (PARTITION BY ip, cluster_index ORDER BY count(*) DESC, min(start_time), "user") AS pos
    FROM clustered WHERE "user" IS NOT NULL GROUP BY ip, cluster_index, "user") WHERE pos = 1)
"""
    rolled = f"""
rolled AS (
  SELECT 'ip:' || ip || '#' || cluster_index AS incident_id, ip, cluster_index, count(*) AS session_count,
    sum(event_count)::BIGINT AS total_events, round(sum(anomaly_score) / count(*), 12) AS avg_anomaly_score,
    sum(auth_failed)::BIGINT AS auth_failed, sum(auth_success)::BIGINT AS auth_success,
    CASE WHEN sum(auth_failed) + sum(auth_success) = 0 THEN 0.0::DOUBLE
         ELSE sum(auth_failed)::DOUBLE / (sum(auth_failed) + sum(auth_success))::DOUBLE END AS auth_fail_ratio,
    sum(auth_failed) > 0 AND sum(auth_success) > 0 AS has_success_after_failures,
    max(auth_failed_streak_max) AS auth_failed_streak_max, max(auth_burst_max_per_minute) AS auth_burst_max_per_minute,
    count(DISTINCT "user") AS distinct_users, least(min(start_time), min(end_time)) AS first_ts,
    greatest(max(start_time), max(end_time)) AS last_ts,
    list_sort(list(DISTINCT "user") FILTER (WHERE "user" IS NOT NULL)) AS targeted_users,
    list(session_id ORDER BY start_time, k_user) AS session_ids
  FROM clustered GROUP BY ip, cluster_index HAVING count(*) >= {min_sessions})
"""
    graded = f"""
graded AS (
  SELECT rolled.*, primary_user, primary_user AS "user",
    {v.iso('first_ts')} AS first_seen, {v.iso('last_ts')} AS last_seen,
    {case(_SEVERITY, [q(a) for a, _ in r.SEVERITY_REASONS])} AS severity,
    {case(_SEVERITY, [q(b) for _, b in r.SEVERITY_REASONS])} AS severity_reason,
    CASE WHEN {' OR '.join(f'({t})' for t in _CONFIDENCE[:5])} THEN 'high'
         WHEN {_F} >= 20 OR {_N} >= 2 OR {_S} >= 0.20::DOUBLE OR {_R} >= 0.80::DOUBLE THEN 'medium' ELSE 'low' END AS confidence,
    {case(_CONFIDENCE, [q(b) for b in r.CONFIDENCE_REASONS])} AS confidence_reason,
    {case(pattern_tests, [q(n) for n in pattern_names])} AS attack_pattern,
    {case(pattern_tests, pattern_reasons)} AS attack_pattern_reason
  FROM rolled LEFT JOIN user_mode USING (ip, cluster_index)),
incidents AS (
  SELECT *, CASE WHEN priority_score >= 68 THEN 'critical' WHEN priority_score >= 45 THEN 'high'
       WHEN priority_score >= 20 THEN 'medium' ELSE 'low' END AS priority,
    'priority derived from severity=' || severity || ' and confidence=' || confidence || ' (score=' || priority_score || ')' AS priority_reason
  FROM (SELECT *, CASE severity || '/' || confidence WHEN 'low/low' THEN 8 WHEN 'low/medium' THEN 15 WHEN 'low/high' THEN 21
      WHEN 'medium/low' THEN 15 WHEN 'medium/medium' THEN 30 WHEN 'medium/high' THEN 42
      WHEN 'high/low' THEN 24 WHEN 'high/medium' THEN 48 WHEN 'high/high' THEN 68 END::BIGINT AS priority_score FROM graded))
"""
    steps = [more] if more else []
    return [*(base or v.feature_views()), SCORED, *steps, MERGED.format(source=source), users, rolled, graded]


INCIDENT_COLUMNS = """incident_id, ip, cluster_index, "user", session_count, total_events,
  round(avg_anomaly_score, 9) AS avg_anomaly_score, auth_failed, auth_success, round(auth_fail_ratio, 9) AS auth_fail_ratio,
  has_success_after_failures, severity, severity_reason, confidence, confidence_reason, priority, priority_score,
  priority_reason, attack_pattern, attack_pattern_reason, primary_user, distinct_users, auth_failed_streak_max,
  auth_burst_max_per_minute, first_seen, last_seen"""


def incidents_all(where: str = "", min_sessions: int = 1) -> str:
    return v.with_views(*incident_views(min_sessions=min_sessions)) + f" SELECT {INCIDENT_COLUMNS} FROM incidents {where}"


def on_incidents(select: str, min_sessions: int = 1) -> str:
    return v.with_views(*incident_views(min_sessions=min_sessions)) + " " + select


def threshold(where: str = "") -> str:
    return v.with_views(*v.feature_views(), SCORED, threshold_view()) + f""" SELECT session_id,
      round(anomaly_score, 9) AS anomaly_score, round(percentile, 9) AS anomaly_percentile, is_anomalous FROM ranked {where}"""


def minmax() -> str:
    return v.with_views(*v.feature_views(), SCORED) + """ SELECT session_id,
      round((anomaly_score - (SELECT min(anomaly_score) FROM scored))
        / ((SELECT max(anomaly_score) FROM scored) - (SELECT min(anomaly_score) FROM scored)), 9) AS score_norm,
      round((auth_burst_max_per_minute - (SELECT min(auth_burst_max_per_minute) FROM scored))::DOUBLE
        / ((SELECT max(auth_burst_max_per_minute) FROM scored) - (SELECT min(auth_burst_max_per_minute) FROM scored)), 9) AS burst_norm
      FROM scored"""


def top_sessions() -> str:
    return v.with_views(*v.feature_views(), SCORED, threshold_view()) + """ SELECT session_id, ip, "user", event_count,
      round(error_ratio, 9) AS error_ratio, round(anomaly_score, 9) AS anomaly_score,
      round(percentile, 9) AS anomaly_percentile, is_anomalous
      FROM ranked WHERE is_anomalous ORDER BY ranked.anomaly_score DESC, session_id LIMIT 20"""
