"""DuckDB statements for log lines, parsing, normalization and generic incidents."""

from __future__ import annotations

from triagelens.oracle import views as v

CLOCK = "strftime(ts, '%H:%M:%S')"
FORMS = {
    "ssh": f"""strftime(ts, '%b %-d ') || {CLOCK} || ' LabSZ sshd[' || user_id || ']: ' ||
        CASE WHEN status = 401 THEN 'Failed password for invalid user ' || coalesce("user", 'admin')
             WHEN status = 200 THEN 'Accepted password for ' || coalesce("user", 'admin')
             WHEN status = 404 THEN 'Connection closed by user ' || coalesce("user", 'x')
             WHEN status = 500 THEN 'Received disconnect, code ' || k
             WHEN k % 3 = 0 THEN 'Accepted publickey for deploy'
             WHEN k % 3 = 1 THEN 'Invalid user guest' || k
             ELSE 'error: maximum authentication attempts exceeded' END ||
        CASE WHEN ip IS NULL THEN ' from unknown' ELSE ' from ' || ip || ' port ' || (1024 + k) END""",
    "apache": f"""'[' || strftime(ts, '%a %b %d ') || {CLOCK} || strftime(ts, ' %Y') || '] [' ||
        CASE k % 9 WHEN 0 THEN 'emerg' WHEN 1 THEN 'Alert' WHEN 2 THEN 'debug' WHEN 3 THEN 'warn'
             WHEN 4 THEN 'odd' ELSE level END || '] ' ||
        CASE k % 11 WHEN 0 THEN 'child pid 7 exit signal Segmentation fault (11)'
             WHEN 1 THEN '[client ' || coalesce(ip, '-') || '] client denied by server configuration'
             WHEN 2 THEN 'File does not exist: /var/www' || coalesce(path, '/')
             WHEN 3 THEN 'Permission denied: access' WHEN 4 THEN 'caught SIGTERM, shutting down'
             WHEN 5 THEN 'Apache configured -- resuming normal operations'
             ELSE 'module state ' || coalesce(message, 'idle') END""",
    "access": f"""coalesce(ip, '-') || ' - - [' || strftime(ts, '%d/%b/%Y:') || {CLOCK} ||
        CASE WHEN k % 2 = 0 THEN ' +0000' ELSE ' +0200' END || '] "' || CASE WHEN k % 3 = 0 THEN 'POST' ELSE 'GET' END ||
        ' ' || coalesce(path, '/') || ' HTTP/1.1" ' || coalesce(status, 304) || ' ' || (100 + k) || ' "-" "' ||
        CASE WHEN k % 10 = 0 THEN '' ELSE 'agent/' || (k % 10) END || '"'""",
    "syslog": f"""CASE WHEN k % 4 = 0 THEN '' ELSE '<' || k || '>' END ||
        strftime(ts, '%b %-d ') || {CLOCK} || ' host' || (user_id % 9) || ' ' ||
        CASE k % 5 WHEN 0 THEN 'sshd[' || user_id || ']: ' WHEN 1 THEN 'cron: ' WHEN 2 THEN 'kernel '
             WHEN 3 THEN ': ' ELSE 'su:' END || event_type || ' by ' || coalesce("user", 'nobody')""",
    "jsonl": """'{"' || CASE WHEN k % 2 = 0 THEN '@timestamp' ELSE 'time' END || '": "' ||
        strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE k % 3 WHEN 0 THEN 'Z' WHEN 1 THEN '+00:00' ELSE '' END ||
        '", "msg": "' || event_type || ' ' || k || '", "' || CASE WHEN k % 4 = 0 THEN 'log_level' ELSE 'level' END || '": "' ||
        level || '", "client_ip": ' || CASE WHEN ip IS NULL THEN 'null' ELSE '"' || ip || '"' END ||
        ', "username": "' || coalesce("user", '') || '", "hostname": "web-' || (k % 5) || '", "app": "' || event_type ||
        '", "status": ' || CASE WHEN status IS NULL THEN '"n/a"' WHEN k % 2 = 0 THEN '"' || status || '"'
                         ELSE status::VARCHAR END ||
        ', "action": "' || CASE WHEN status = 401 THEN 'login_failed' ELSE 'other' END || '"' ||
        CASE WHEN k % 10 = 7 THEN ', "request_id": "r-' || (user_id % 50) || '"' ELSE '' END || '}'""",
}
FORMS["jsonl_objects"] = FORMS["jsonl"]
BAD = {
    "jsonl": "CASE WHEN k % 2 = 0 THEN 'not json ' || seq ELSE '[' || seq || ']' END",
    "jsonl_objects": "'[' || seq || ']'",
}


def lines(kind: str) -> list[str]:
    bad = BAD.get(kind, "'not a log line ' || seq")
    return [
        v.LOG_EVENTS,
        f"""lines AS (SELECT seq, seq + 1 AS line_no,
            CASE WHEN seq % 50 = 17 THEN '' WHEN seq % 50 = 49 THEN {bad} ELSE {FORMS[kind]} END AS value FROM log_events)""",
    ]


SSH = r"^(\w{3})\s+(\d{1,2})\s+(\d{2}:\d{2}:\d{2})\s+(\S+)\s+(\S+):\s+(.*)$"
PARSED_SSH = rf"""
parsed_ssh AS (
  SELECT seq, value AS raw, strptime('2024 ' || m.mon || ' ' || m.d || ' ' || m.t, '%Y %b %d %H:%M:%S') AS ts,
    nullif(regexp_extract(m.msg, '\b(\d{{1,3}}(?:\.\d{{1,3}}){{3}})\b', 1), '') AS ip,
    nullif(regexp_extract(m.msg, 'user (\S+)', 1), '') AS "user",
    CASE WHEN contains(m.msg, 'Failed password') THEN 401 WHEN contains(m.msg, 'Accepted password') THEN 200 END AS status
  FROM (SELECT *, regexp_extract(value, '{SSH}', ['mon', 'd', 't', 'host', 'proc', 'msg']) AS m FROM lines
        WHERE regexp_matches(value, '{SSH}')))
"""
APACHE = r"^\[([^\]]+)\]\s+\[([^\]]+)\]\s+(.*)$"
PARSED_APACHE = rf"""
parsed_apache AS (
  SELECT seq, value AS raw, strptime(m.t, '%a %b %d %H:%M:%S %Y') AS ts, trim(m.lvl) AS level, trim(m.msg) AS message
  FROM (SELECT *, regexp_extract(value, '{APACHE}', ['t', 'lvl', 'msg']) AS m FROM lines
        WHERE regexp_matches(value, '{APACHE}')))
"""
TEXT_EVENTS = """
text_events AS (
  SELECT seq, ts, {ip} AS ip, {user} AS "user", NULL::VARCHAR AS path, {status} AS status, {source} AS source,
    {level} AS level, {message} AS message FROM {parsed})
"""


def ssh_text_features() -> list[str]:
    """Features of the sessions in SSH log text."""
    events = TEXT_EVENTS.format(
        ip="ip", user='"user"', status="status::BIGINT", source="'ssh_auth'", level="NULL::VARCHAR", message="NULL::VARCHAR", parsed="parsed_ssh"
    )
    return [*lines("ssh"), PARSED_SSH, events, v.sessions("text_events"), v.features()]


def apache_text_features() -> list[str]:
    """Features of the sessions in Apache error log text."""
    none = "NULL::VARCHAR"
    events = TEXT_EVENTS.format(
        ip=none, user=none, status="NULL::BIGINT", source="'apache_error'", level="level", message="message", parsed="parsed_apache"
    )
    return [*lines("apache"), PARSED_APACHE, events, v.sessions("text_events"), v.features()]


ACCESS = r'^(\S+) \S+ \S+ \[([^\]]+)\] "(\S+) (\S+) \S+" (\d{3}) \S+ ".*" "(.*)"'


def parse_ssh() -> str:
    return v.with_views(*lines("ssh"), PARSED_SSH) + f""" SELECT seq, {v.iso('ts')} AS ts, ip, "user", status::BIGINT AS status, raw,
      'ssh_auth' AS source FROM parsed_ssh"""


def parse_apache() -> str:
    return v.with_views(*lines("apache"), PARSED_APACHE) + f""" SELECT seq, {v.iso('ts')} AS ts, level, message, raw,
      'apache_error' AS source FROM parsed_apache"""


def parse_access() -> str:
    return v.with_views(*lines("access")) + rf""" SELECT seq, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS ts, ip, method, path, status, user_agent FROM (
      SELECT seq, strptime(split_part(m.t, ' ', 1), '%d/%b/%Y:%H:%M:%S')
          - to_hours(substr(split_part(m.t, ' ', 2), 1, 3)::INT) - to_minutes((substr(split_part(m.t, ' ', 2), 1, 1) || substr(split_part(m.t, ' ', 2), 4, 2))::INT) AS ts,
        m.ip AS ip, m.method AS method, m.path AS path, m.st::BIGINT AS status, nullif(m.ua, '') AS user_agent
      FROM (SELECT *, regexp_extract(value, '{ACCESS}', ['ip', 't', 'method', 'path', 'st', 'ua']) AS m FROM lines
            WHERE regexp_matches(value, '{ACCESS}')))"""


def normalize_ssh_views() -> list[str]:
    return [
        *lines("ssh"),
        PARSED_SSH,
        f"""norm AS (
  SELECT *, CASE WHEN event_action IN ('login_failed', 'invalid_user', 'auth_attempts_exceeded') THEN 'warn' ELSE 'info' END AS severity,
    coalesce(src_ip || '|' || "user", src_ip, "user") AS session_hint
  FROM (SELECT seq, {v.iso('ts')} AS timestamp, ts AS event_ts, 'ssh' AS source_type, 'auth' AS event_category, 'ssh' AS service,
      NULL::VARCHAR AS host, ip AS src_ip, "user", status::BIGINT AS status_code, raw AS message,
      CASE WHEN status = 401 OR contains(lower(raw), 'failed password') THEN 'login_failed'
           WHEN status = 200 OR contains(lower(raw), 'accepted password') THEN 'login_success'
           WHEN contains(lower(raw), 'accepted publickey') THEN 'login_success'
           WHEN contains(lower(raw), 'invalid user') THEN 'invalid_user'
           WHEN contains(lower(raw), 'maximum authentication attempts exceeded') THEN 'auth_attempts_exceeded'
           WHEN contains(lower(raw), 'connection closed') THEN 'connection_closed'
           WHEN contains(lower(raw), 'disconnect') THEN 'disconnect' ELSE 'ssh_event' END AS event_action
    FROM parsed_ssh))""",
    ]


def normalize_apache_views() -> list[str]:
    return [
        *lines("apache"),
        PARSED_APACHE,
        f"""norm AS (
  SELECT seq, {v.iso('ts')} AS timestamp, ts AS event_ts, 'apache' AS source_type, 'application' AS event_category,
    'apache' AS service, NULL::VARCHAR AS host, NULL::VARCHAR AS src_ip, NULL::VARCHAR AS "user", message, level AS apache_level,
    NULL::VARCHAR AS session_hint,
    CASE WHEN lower(level) IN ('emerg', 'alert', 'crit', 'critical', 'error') THEN 'error'
         WHEN lower(level) IN ('warn', 'warning') THEN 'warn' ELSE 'info' END AS severity,
    CASE WHEN contains(lower(message), 'segmentation fault') THEN 'process_crash'
         WHEN contains(lower(message), 'client denied') THEN 'access_denied'
         WHEN contains(lower(message), 'file does not exist') THEN 'missing_file'
         WHEN contains(lower(message), 'permission denied') THEN 'permission_denied'
         WHEN contains(lower(message), 'caught sigterm') OR contains(lower(message), 'shutting down') THEN 'service_shutdown'
         WHEN contains(lower(message), 'resuming normal operations') THEN 'service_start'
         WHEN lower(level) IN ('emerg', 'alert', 'crit', 'critical', 'error') THEN 'apache_error'
         WHEN lower(level) IN ('warn', 'warning') THEN 'apache_warn'
         WHEN lower(level) IN ('notice', 'info', 'debug') THEN 'apache_notice' ELSE 'apache_event' END AS event_action
  FROM parsed_apache)""",
    ]


NORM_COLUMNS = 'seq, timestamp, source_type, event_category, event_action, severity, src_ip, "user", host, service, message, session_hint'


def normalized(views: list[str], more: str = "") -> str:
    return v.with_views(*views) + f" SELECT {NORM_COLUMNS}{more} FROM norm"


def _jsonl_time(text: str) -> str:
    return f"CASE WHEN ends_with({text}, 'Z') THEN left({text}, length({text}) - 1) || '+00:00' ELSE {text} END"


def jsonl_views(kind: str = "jsonl", mapped: bool = True) -> list[str]:
    """norm: events of the JSON lines, with or without the field mapping."""
    j = lambda key: f"json_extract_string(value, '$.\"{key}\"')"
    category = "'auth'" if mapped else "NULL::VARCHAR"
    status = f"try_cast({j('status')} AS BIGINT)" if mapped else "NULL::BIGINT"
    raw_status = j("status") if mapped else "NULL::VARCHAR"
    extra = (
        """list_aggregate(list_sort(list_filter(json_keys(value),
            lambda x: NOT (x = 'client_ip' AND json_extract_string(value, '$.client_ip') IS NULL)
             AND NOT (x = 'username' AND json_extract_string(value, '$.username') = ''))), 'string_agg', ',')"""
        if mapped
        else "'status'"
    )
    return [
        *lines(kind),
        f"""norm AS (
  SELECT seq, {_jsonl_time(f"coalesce({j('@timestamp')}, {j('time')})")} AS timestamp, 'generic_jsonl' AS source_type,
    {category} AS event_category, {j('action')} AS event_action, coalesce({j('level')}, {j('log_level')}) AS severity,
    {j('client_ip')} AS src_ip, nullif({j('username')}, '') AS "user", {j('hostname')} AS host, {j('app')} AS service,
    {j('msg')} AS message, {j('request_id')} AS session_hint, {status} AS status_code, {raw_status} AS status_code_raw,
    {extra} AS extra_keys
  FROM lines WHERE value <> '' AND json_valid(value) AND json_type(value) = 'OBJECT')""",
    ]


def jsonl_errors() -> str:
    return v.with_views(*lines("jsonl")) + """ SELECT line_no, reason, value AS raw, 'line ' || line_no || ': ' || reason AS message FROM (
      SELECT *, CASE WHEN NOT json_valid(value) THEN 'invalid JSON'
        WHEN json_type(value) <> 'OBJECT' THEN 'expected JSON object, got list' END AS reason FROM lines WHERE value <> '')
      WHERE reason IS NOT NULL"""


SYSLOG = r"^(?:<(\d{1,3})>)?([A-Z][a-z]{2}\s{1,2}\d{1,2}\s\d{2}:\d{2}:\d{2})\s+(\S+)\s+(.*?)\s*$"
TAG = r"^([A-Za-z0-9_.\-/]+)(?:\[(\d+)\])?(?::\s*|\s+)?(.*)$"


def syslog_views() -> list[str]:
    return [
        *lines("syslog"),
        rf"""heads AS (SELECT seq, value, regexp_extract(value, '{SYSLOG}', ['pri', 't', 'host', 'msg']) AS m FROM lines
            WHERE regexp_matches(value, '{SYSLOG}')),
tags AS (SELECT seq, value, m, trim(m.msg) AS msg, regexp_matches(trim(m.msg), '{TAG}') AS tagged,
    regexp_extract(trim(m.msg), '{TAG}', ['tag', 'pid', 'content']) AS g, try_cast(nullif(m.pri, '') AS BIGINT) AS pri,
    strptime('2024 ' || m.t, '%Y %b %d %H:%M:%S') AS ts FROM heads),
norm AS (
  SELECT seq, strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS timestamp, 'generic_syslog' AS source_type, 'syslog' AS event_category,
    NULL::VARCHAR AS event_action,
    ['emergency', 'alert', 'critical', 'error', 'warn', 'notice', 'info', 'debug'][pri % 8 + 1] AS severity,
    NULL::VARCHAR AS src_ip, NULL::VARCHAR AS "user", m.host AS host, CASE WHEN tagged THEN g.tag END AS service,
    CASE WHEN tagged AND trim(g.content) <> '' THEN trim(g.content) ELSE msg END AS message, NULL::VARCHAR AS session_hint,
    CASE WHEN tagged THEN nullif(g.pid, '') END AS pid, (pri // 8)::VARCHAR AS facility, pri::VARCHAR AS pri FROM tags)""",
    ]


SIMPLE = r"^(?:<(\d+)>)?([A-Z][a-z]{2}\s{1,2}\d{1,2}\s\d{2}:\d{2}:\d{2})\s+(\S+)\s+(.*)$"


def syslog_simple_views() -> list[str]:
    return [
        *lines("syslog"),
        rf"""heads AS (SELECT seq, regexp_extract(trim(value), '{SIMPLE}', ['pri', 't', 'host', 'msg']) AS m FROM lines
            WHERE regexp_matches(trim(value), '{SIMPLE}')),
norm AS (
  SELECT seq, strftime(strptime('2024 ' || m.t, '%Y %b %d %H:%M:%S'), '%Y-%m-%dT%H:%M:%S') AS timestamp,
    'generic_jsonl' AS source_type, NULL::VARCHAR AS event_category, NULL::VARCHAR AS event_action,
    ['emerg', 'alert', 'crit', 'error', 'warning', 'notice', 'info', 'debug'][try_cast(nullif(m.pri, '') AS BIGINT) % 8 + 1] AS severity,
    NULL::VARCHAR AS src_ip, NULL::VARCHAR AS "user", m.host AS host,
    CASE WHEN contains(m.msg, ':') THEN nullif(trim(split_part(m.msg, ':', 1)), '') END AS service,
    CASE WHEN contains(m.msg, ':') THEN trim(substr(m.msg, strpos(m.msg, ':') + 1)) ELSE m.msg END AS message,
    NULL::VARCHAR AS session_hint, (try_cast(nullif(m.pri, '') AS BIGINT) // 8)::VARCHAR AS facility FROM heads)""",
    ]


def rejects(kind: str, pattern: str, reason: str) -> str:
    return v.with_views(*lines(kind)) + f""" SELECT line_no, '{reason}' AS reason, value AS raw,
      'line ' || line_no || ': {reason}' AS message FROM lines WHERE value <> '' AND NOT regexp_matches(value, '{pattern}')"""


# --- generic incidents ---------------------------------------------------------

NORMALIZED = """
norm AS (
  SELECT seq, CASE WHEN k = 42 THEN 'not-a-time' WHEN k = 43 THEN NULL
      ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(ts) % 1000000 = 0 THEN '' ELSE '.' || lpad((epoch_us(ts) % 1000000)::VARCHAR, 6, '0') END END AS timestamp,
    CASE WHEN k NOT IN (42, 43) THEN ts END AS event_ts,
    CASE WHEN user_id % 2 = 0 THEN 'generic_jsonl' ELSE 'generic_syslog' END AS source_type, message AS raw_message,
    CASE WHEN k % 8 = 0 THEN NULL ELSE 'auth' END AS event_category,
    CASE WHEN status = 401 THEN 'login_failed' WHEN status = 200 THEN 'Login_Success' WHEN k % 6 = 0 THEN NULL ELSE event_type END AS event_action,
    CASE WHEN level = 'error' AND k % 5 = 0 THEN 'ERROR' WHEN k % 17 = 0 THEN NULL ELSE level END AS severity,
    CASE WHEN k % 10 IN (5, 6) THEN NULL ELSE ip END AS src_ip, NULL::VARCHAR AS dst_ip,
    CASE WHEN k % 10 IN (5, 6) THEN NULL ELSE "user" END AS "user",
    CASE WHEN k % 4 = 3 THEN NULL ELSE 'web-' || (k % 3) END AS host, CASE WHEN k % 5 = 0 THEN NULL ELSE event_type END AS service,
    message, CASE WHEN k % 10 = 7 THEN 's-' || (user_id % 50) END AS session_hint, level AS apache_level, status
  FROM log_events)
"""


def grouped(minutes: int = 15) -> str:
    return f"""
grouped AS (
  SELECT *, CASE WHEN session_hint IS NOT NULL THEN 'session_hint:' || session_hint
      WHEN src_ip IS NOT NULL AND "user" IS NOT NULL THEN 'src_ip_user:' || src_ip || '|' || "user"
      WHEN src_ip IS NOT NULL THEN 'src_ip:' || src_ip WHEN "user" IS NOT NULL THEN 'user:' || "user"
      WHEN host IS NOT NULL AND service IS NOT NULL THEN 'host_service:' || host || '|' || service
      WHEN host IS NOT NULL THEN 'host:' || host WHEN service IS NOT NULL THEN 'service:' || service ELSE 'unknown' END AS group_key,
    CASE WHEN event_ts IS NULL THEN 'no_time'
      ELSE strftime(date_trunc('hour', event_ts) + to_minutes((minute(event_ts) // {minutes}) * {minutes}), '%Y-%m-%dT%H:%M:%S') END AS bucket
  FROM norm)
"""


GENERIC = f"""
counted AS (
  SELECT group_key, bucket, group_key || '||' || bucket AS bucket_id, count(*) AS event_count,
    count(*) FILTER (WHERE lower(severity) = 'error') AS error_count,
    count(*) FILTER (WHERE lower(severity) IN ('warn', 'warning')) AS warning_count,
    count(DISTINCT "user") AS distinct_users, count(DISTINCT host) AS distinct_hosts, count(DISTINCT src_ip) AS distinct_src_ips,
    count(*) FILTER (WHERE lower(event_action) = 'login_failed') > 0 AS any_login_failed,
    min(event_ts) AS first_ts, max(event_ts) AS last_ts, arg_min(source_type, seq) AS source_type
  FROM grouped GROUP BY group_key, bucket),
gincidents AS (
  SELECT *, CASE WHEN severity = 'high' AND confidence = 'high' THEN 'critical' WHEN severity = 'high' OR confidence = 'high' THEN 'high'
      WHEN severity = 'medium' THEN 'medium' ELSE 'low' END AS priority,
    'generic:' || group_key || '#' || incident_index AS incident_id,
    upper(left(severity, 1)) || substr(severity, 2) || ' generic incident for ' || group_key AS summary_title,
    'Grouped ' || event_count || ' event(s) for ' || group_key || ' between ' || coalesce(first_seen, 'unknown') || ' and '
      || coalesce(last_seen, 'unknown') || ', with ' || error_count || ' error event(s), ' || warning_count || ' warning event(s), across '
      || distinct_users || ' user(s), ' || distinct_hosts || ' host(s), and ' || distinct_src_ips || ' source IP(s). Detected pattern: '
      || attack_pattern || '.' AS summary_description
  FROM (SELECT *, row_number() OVER (ORDER BY bucket_id COLLATE C) AS incident_index, {v.iso('first_ts')} AS first_seen, {v.iso('last_ts')} AS last_seen,
      CASE WHEN error_count >= 5 THEN 'high' WHEN error_count >= 1 OR warning_count >= 3 OR event_count >= 10 THEN 'medium' ELSE 'low' END AS severity,
      CASE WHEN event_count >= 10 OR error_count >= 3 THEN 'high' WHEN event_count >= 4 OR error_count >= 1 THEN 'medium' ELSE 'low' END AS confidence,
      CASE WHEN error_count >= 3 THEN 'error_spike' WHEN warning_count >= 3 THEN 'warning_burst'
           WHEN any_login_failed THEN 'auth_fail_burst' ELSE 'unknown_anomalous_behavior' END AS attack_pattern
    FROM counted))
""".replace(" COLLATE C", "")


def generic_views(minutes: int = 15, events: list[str] | None = None) -> list[str]:
    return [*(events or [v.LOG_EVENTS, NORMALIZED]), grouped(minutes), GENERIC]


GENERIC_COLUMNS = """incident_id, group_key, bucket, severity, confidence, priority, attack_pattern, event_count, error_count,
  warning_count, distinct_users, distinct_hosts, distinct_src_ips, first_seen, last_seen, source_type, summary_title, summary_description"""


def generic_incidents(minutes: int = 15, events: list[str] | None = None) -> str:
    return v.with_views(*generic_views(minutes, events)) + f" SELECT {GENERIC_COLUMNS} FROM gincidents"


def on_generic(select: str, minutes: int = 15) -> str:
    return v.with_views(*generic_views(minutes)) + " " + select


def summary(views: list[str], dims: dict[str, str]) -> str:
    """Long table of counts; null values are not counted."""
    parts = [f"SELECT '{d}' AS dimension, {e} AS value, count(*) AS n FROM norm WHERE {e} IS NOT NULL GROUP BY 2" for d, e in dims.items()]
    return v.with_views(*views) + " " + " UNION ALL ".join(parts)
