"""DuckDB views over the given tables: the checks' own reading of each step."""

from __future__ import annotations

ISO = "strftime({0}, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us({0}) % 1000000 = 0 THEN '' ELSE '.' || lpad((epoch_us({0}) % 1000000)::VARCHAR, 6, '0') END"


def iso(ts: str) -> str:
    return "(" + ISO.format(ts) + ")"


LOG_EVENTS = """
log_events AS (
  SELECT event_id AS seq,
    make_timestamp(1704067200000000 + (epoch_us(ts) - 1704067200000000) // 24) AS ts,
    CASE WHEN user_id % 10 = 0 THEN '10.0.0.' || ((user_id // 10) % 3)
         WHEN user_id % 10 = 9 THEN NULL
         ELSE '10.1.' || (user_id // 768) || '.' || ((user_id // 3) % 256) END AS ip,
    CASE WHEN user_id % 10 = 0 AND (user_id // 10) % 3 = 2 THEN 'root'
         WHEN user_id % 10 = 8 THEN NULL ELSE 'u' || user_id END AS "user",
    k,
    CASE WHEN event_type = 'view' THEN NULL WHEN k < 5 THEN '/item/' || event_id ELSE '/p/' || k END AS path,
    CASE WHEN user_id % 10 = 0 THEN 401
         WHEN user_id % 10 = 1 THEN CASE WHEN event_type = 'signup' THEN 200 ELSE 401 END
         ELSE CASE event_type WHEN 'error' THEN 500 WHEN 'purchase' THEN 200
              WHEN 'signup' THEN 401 WHEN 'click' THEN 404 END END AS status,
    CASE WHEN user_id % 7 = 0 AND k % 2 = 0 THEN 'access' ELSE 'ssh_auth' END AS source,
    CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'warn'
         WHEN 'purchase' THEN 'crit' ELSE 'notice' END AS level,
    CASE WHEN event_type = 'view' THEN NULL WHEN k >= 97 THEN event_type || ' id ' || event_id
         ELSE event_type || ' k' || (k % 7) END AS message,
    user_id, event_type
  FROM (SELECT *, regexp_extract(props, '([0-9]+)', 1)::BIGINT AS k FROM events))
"""

APACHE_EVENTS = """
apache_events AS (SELECT * REPLACE (NULL::VARCHAR AS ip, NULL::VARCHAR AS "user", 'apache_error' AS source) FROM log_events)
"""


def sessions(source: str = "log_events", gap_seconds: int = 1800) -> str:
    """sess_events: events with session_no and session_start."""
    return f"""
numbered AS (
  SELECT *, coalesce(ip, '') AS k_ip, coalesce("user", '') AS k_user,
    CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w <= {gap_seconds * 1000000} THEN 0 ELSE 1 END AS starts
  FROM {source} WINDOW w AS (PARTITION BY coalesce(ip, ''), coalesce("user", '') ORDER BY ts, seq)),
marked AS (
  SELECT *, (sum(starts) OVER (PARTITION BY k_ip, k_user ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) - 1)::BIGINT AS session_no
  FROM numbered),
sess_events AS (
  SELECT *, min(ts) OVER (PARTITION BY k_ip, k_user, session_no) AS session_start,
    k_ip || '||' || k_user || '||' || {iso("min(ts) OVER (PARTITION BY k_ip, k_user, session_no)")} AS session_id
  FROM marked)
"""


def features(window_seconds: int = 60) -> str:
    """feats: one row per session, all features, from sess_events."""
    w = f'(PARTITION BY k_ip, k_user, session_no ORDER BY epoch_us(ts) RANGE BETWEEN {window_seconds * 1000000} PRECEDING AND CURRENT ROW)'
    return f"""
known AS (
  SELECT *,
    sum(CASE WHEN status <> 401 THEN 1 ELSE 0 END) OVER o AS fail_island,
    sum(CASE WHEN status NOT BETWEEN 500 AND 599 THEN 1 ELSE 0 END) OVER o AS server_island,
    max(CASE WHEN status = 401 THEN 1 ELSE 0 END) OVER o AS failed_yet
  FROM sess_events WHERE status IS NOT NULL
  WINDOW o AS (PARTITION BY k_ip, k_user, session_no ORDER BY ts, seq ROWS UNBOUNDED PRECEDING)),
fail_runs AS (
  SELECT k_ip, k_user, session_no, max(n) AS streak FROM (
    SELECT k_ip, k_user, session_no, fail_island, count(*) FILTER (WHERE status = 401) AS n
    FROM known GROUP BY ALL) GROUP BY ALL),
server_runs AS (
  SELECT k_ip, k_user, session_no, max(n) AS streak FROM (
    SELECT k_ip, k_user, session_no, server_island, count(*) FILTER (WHERE status BETWEEN 500 AND 599) AS n
    FROM known GROUP BY ALL) GROUP BY ALL),
late_success AS (
  SELECT k_ip, k_user, session_no, count(*) FILTER (WHERE status = 200 AND failed_yet = 1) AS n FROM known GROUP BY ALL),
peaks AS (
  SELECT k_ip, k_user, session_no, max(n) AS n, max(n404) AS n404, max(n5xx) AS n5xx, max(nerr) AS nerr,
    max(gap) AS gap
  FROM (SELECT k_ip, k_user, session_no, count(*) OVER w AS n,
      count(*) FILTER (WHERE status = 404) OVER w AS n404,
      count(*) FILTER (WHERE status BETWEEN 500 AND 599) OVER w AS n5xx,
      count(*) FILTER (WHERE level = 'error') OVER w AS nerr,
      epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY k_ip, k_user, session_no ORDER BY ts, seq) AS gap
    FROM sess_events WINDOW w AS {w}) GROUP BY ALL),
path_n AS (SELECT path, count(*) AS n FROM sess_events WHERE path IS NOT NULL GROUP BY path),
message_n AS (SELECT message, count(*) AS n FROM sess_events WHERE message IS NOT NULL GROUP BY message),
rare AS (
  SELECT k_ip, k_user, session_no, count(DISTINCT e.path) AS paths, count(DISTINCT e.message) AS messages,
    count(e.path) AS path_events, count(e.message) AS message_events,
    count(*) FILTER (WHERE p.n = 1) AS rare_paths, count(*) FILTER (WHERE m.n = 1) AS rare_messages
  FROM sess_events e LEFT JOIN path_n p ON e.path = p.path LEFT JOIN message_n m ON e.message = m.message GROUP BY ALL),
base AS (
  SELECT k_ip, k_user, session_no, any_value(session_id) AS session_id, any_value(ip) AS ip, any_value("user") AS "user",
    min(ts) AS start_time, max(ts) AS end_time, count(*) AS event_count,
    (max(epoch_us(ts)) - min(epoch_us(ts))) / 1000000.0::DOUBLE AS duration_seconds,
    count(*) FILTER (WHERE status BETWEEN 400 AND 499) AS status_4xx,
    count(*) FILTER (WHERE status BETWEEN 500 AND 599) AS status_5xx,
    count(*) FILTER (WHERE level = 'error') AS error_events,
    count(*) FILTER (WHERE level = 'notice') AS notice_events,
    count(*) FILTER (WHERE level IN ('crit', 'alert', 'emerg')) AS high_events,
    count(*) FILTER (WHERE status = 401) AS auth_failed, count(*) FILTER (WHERE status = 200) AS auth_success,
    count(*) FILTER (WHERE hour(ts) < 4) AS rare_hour_events, count(DISTINCT source) AS source_count
  FROM sess_events GROUP BY k_ip, k_user, session_no),
ip_base AS (
  SELECT ip, count(*) AS sessions, sum(event_count)::BIGINT AS events, min(start_time) AS first_seen,
    sum(event_count)::DOUBLE / count(*) AS mean FROM base WHERE ip IS NOT NULL GROUP BY ip),
user_base AS (
  SELECT "user", count(*) AS sessions, sum(event_count)::BIGINT AS events, min(start_time) AS first_seen,
    sum(event_count)::DOUBLE / count(*) AS mean FROM base WHERE "user" IS NOT NULL GROUP BY "user"),
feats AS (
  SELECT b.k_ip, b.k_user, b.session_no, b.session_id, b.ip, b."user", b.start_time, b.end_time,
    b.event_count, b.duration_seconds, b.status_4xx, b.status_5xx,
    (b.status_4xx + b.status_5xx) / b.event_count::DOUBLE AS error_ratio,
    b.error_events, b.notice_events, b.error_events / b.event_count::DOUBLE AS error_event_ratio,
    b.auth_failed, b.auth_success,
    CASE WHEN b.auth_failed + b.auth_success = 0 THEN 0.0::DOUBLE
         ELSE b.auth_failed / (b.auth_failed + b.auth_success)::DOUBLE END AS auth_fail_ratio,
    b.event_count / greatest(b.duration_seconds, 1.0::DOUBLE) AS avg_events_per_second,
    r.paths AS unique_paths, b.source_count, (b.source_count > 1)::BIGINT AS has_mixed_sources,
    coalesce(f.streak, 0) AS auth_failed_streak_max, coalesce(l.n, 0) AS success_after_failure_count,
    p.n AS auth_burst_max_per_minute,
    CASE WHEN b.event_count < 2 THEN 0.0::DOUBLE ELSE b.duration_seconds / (b.event_count - 1) END AS mean_inter_event_gap_seconds,
    coalesce(p.gap, 0) / 1000000.0::DOUBLE AS max_inter_event_gap_seconds,
    (b."user" IS NOT NULL)::BIGINT AS ssh_distinct_users,
    (b."user" IS NOT NULL AND b.ip IS NOT NULL)::BIGINT AS ssh_distinct_ips_per_user,
    (b."user" IS NOT NULL)::BIGINT AS ssh_distinct_targeted_users,
    (b.rare_hour_events > b.event_count / 2.0::DOUBLE)::BIGINT AS ssh_rare_hour,
    coalesce(b.start_time = i.first_seen, false)::BIGINT AS first_seen_ip_flag,
    coalesce(b.start_time = u.first_seen, false)::BIGINT AS first_seen_user_flag,
    coalesce(i.sessions < 3, false)::BIGINT AS rare_seen_ip_flag,
    coalesce(u.sessions < 3, false)::BIGINT AS rare_seen_user_flag,
    coalesce(i.mean, 0.0::DOUBLE) AS ip_events_per_session,
    coalesce(b.event_count - i.mean, 0.0::DOUBLE) AS ip_events_per_session_deviation,
    coalesce(u.mean, 0.0::DOUBLE) AS user_events_per_session,
    coalesce(b.event_count - u.mean, 0.0::DOUBLE) AS user_events_per_session_deviation,
    coalesce(s.streak, 0) AS apache_5xx_streak_max, p.n404 AS apache_404_burst_max_per_minute,
    p.n5xx AS apache_5xx_burst_max_per_minute, p.nerr AS apache_error_burst_max_per_minute,
    r.paths AS apache_distinct_paths,
    CASE WHEN r.path_events = 0 THEN 0.0::DOUBLE ELSE r.rare_paths / r.path_events::DOUBLE END AS apache_rare_path_ratio,
    r.messages AS apache_distinct_message_templates, r.rare_messages AS apache_rare_error_message_count,
    CASE WHEN r.message_events = 0 THEN 0.0::DOUBLE ELSE r.rare_messages / r.message_events::DOUBLE END AS apache_rare_error_message_ratio,
    (b.rare_hour_events > b.event_count / 2.0::DOUBLE)::BIGINT AS apache_rare_hour,
    CASE WHEN b.notice_events > 0 THEN b.error_events / b.notice_events::DOUBLE
         ELSE (b.error_events > 0)::INT::DOUBLE END AS apache_error_vs_notice_ratio,
    b.high_events AS apache_high_severity_events, b.high_events / b.event_count::DOUBLE AS apache_high_severity_ratio
  FROM base b JOIN rare r USING (k_ip, k_user, session_no) JOIN peaks p USING (k_ip, k_user, session_no)
    LEFT JOIN fail_runs f USING (k_ip, k_user, session_no) LEFT JOIN server_runs s USING (k_ip, k_user, session_no)
    LEFT JOIN late_success l USING (k_ip, k_user, session_no)
    LEFT JOIN ip_base i ON b.ip = i.ip LEFT JOIN user_base u ON b."user" = u."user")
"""


def with_views(*views: str) -> str:
    return "WITH " + ",\n".join(v.strip() for v in views)


def feature_views(source: str = "log_events", window_seconds: int = 60) -> list[str]:
    views = [LOG_EVENTS]
    if source == "apache_events":
        views.append(APACHE_EVENTS)
    return [*views, sessions(source), features(window_seconds)]
