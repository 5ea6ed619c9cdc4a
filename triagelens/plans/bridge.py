"""The given ``events`` table seen as log events, records and log lines.

The tables hold no log files.  These views give every log job whole-table input:
each event becomes one log event, one normalized event, or one line of text.
Time is compressed 24-fold so that the 30 and 60 minute constants matter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triagelens.functions.text import once
from triagelens.operators.normalize import NORMALIZED, event_time

ORIGIN = 1_704_067_200_000_000  # 2024-01-01 in microseconds


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def log_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_log_events(table(spark, sf_dir, "events"))


def dealt_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log events dealt by their number, for work that costs far more than sending a row: a
    file's row group is read by one task, however many cores there are."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return as_log_events(table(spark, sf_dir, "events").repartition(n, "event_id"))


BLOCK = 8192


def events_in_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log events dealt in blocks of neighbouring numbers: the work of a row group is spread,
    and events of one group, which lie close together, still meet before a shuffle."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return as_log_events(table(spark, sf_dir, "events").repartition(n, F.floor(F.col("event_id") / BLOCK)))


def as_log_events(table_or_stream: DataFrame) -> DataFrame:
    events = once(table_or_stream, "k", F.regexp_extract("props", "([0-9]+)", 1).cast("bigint"))
    return events.selectExpr(
        "event_id AS seq",
        f"timestamp_micros({ORIGIN} + (unix_micros(cast(ts AS timestamp)) - {ORIGIN}) div 24) AS ts",
        """CASE WHEN user_id % 10 = 0 THEN concat('10.0.0.', (user_id div 10) % 3)
                WHEN user_id % 10 = 9 THEN NULL
                ELSE concat('10.1.', user_id div 768, '.', (user_id div 3) % 256) END AS ip""",
        """CASE WHEN user_id % 10 = 0 AND (user_id div 10) % 3 = 2 THEN 'root'
                WHEN user_id % 10 = 8 THEN NULL ELSE concat('u', user_id) END AS user""",
        "cast(NULL AS string) AS method",
        "k",
        """CASE WHEN event_type = 'view' THEN NULL
                WHEN k < 5 THEN concat('/item/', event_id)
                ELSE concat('/p/', k) END AS path""",
        """CASE WHEN user_id % 10 = 0 THEN 401
                WHEN user_id % 10 = 1 THEN CASE WHEN event_type = 'signup' THEN 200 ELSE 401 END
                ELSE CASE event_type WHEN 'error' THEN 500 WHEN 'purchase' THEN 200
                     WHEN 'signup' THEN 401 WHEN 'click' THEN 404 END END AS status""",
        "cast(NULL AS string) AS user_agent",
        "props AS raw",
        """CASE WHEN user_id % 7 = 0 AND k % 2 = 0
                THEN 'access' ELSE 'ssh_auth' END AS source""",
        """CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'warn'
                WHEN 'purchase' THEN 'crit' ELSE 'notice' END AS level""",
        """CASE WHEN event_type = 'view' THEN NULL
                WHEN k >= 97
                THEN concat(event_type, ' id ', event_id)
                ELSE concat(event_type, ' k', k % 7)
                END AS message""",
        "user_id",
        "event_type",
    )


def apache_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same events as one Apache error log: no ip, no user, one identity."""
    none = F.lit(None).cast("string")
    return log_events(spark, sf_dir).withColumns({"ip": none, "user": none, "source": F.lit("apache_error")})


def lines_of(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """One text line per event in the format ``kind``; every 50th is malformed."""
    e = dealt_events(spark, sf_dir).withColumn("line_no", F.col("seq") + 1)
    clock = "date_format(ts, 'HH:mm:ss')"
    forms = {
        "ssh": f"""concat(date_format(ts, 'MMM d '), {clock}, ' LabSZ sshd[', user_id, ']: ',
            CASE WHEN status = 401 THEN concat('Failed password for invalid user ', coalesce(user, 'admin'))
                 WHEN status = 200 THEN concat('Accepted password for ', coalesce(user, 'admin'))
                 WHEN status = 404 THEN concat('Connection closed by user ', coalesce(user, 'x'))
                 WHEN status = 500 THEN concat('Received disconnect, code ', k)
                 WHEN k % 3 = 0 THEN 'Accepted publickey for deploy'
                 WHEN k % 3 = 1 THEN concat('Invalid user guest', k)
                 ELSE 'error: maximum authentication attempts exceeded' END,
            CASE WHEN ip IS NULL THEN ' from unknown' ELSE concat(' from ', ip, ' port ', 1024 + k) END)""",
        "apache": f"""concat('[', date_format(ts, 'EEE MMM dd '), {clock}, date_format(ts, ' yyyy'), '] [',
            CASE k % 9 WHEN 0 THEN 'emerg' WHEN 1 THEN 'Alert' WHEN 2 THEN 'debug' WHEN 3 THEN 'warn'
                 WHEN 4 THEN 'odd' ELSE level END, '] ',
            CASE k % 11 WHEN 0 THEN 'child pid 7 exit signal Segmentation fault (11)'
                 WHEN 1 THEN concat('[client ', coalesce(ip, '-'), '] client denied by server configuration')
                 WHEN 2 THEN concat('File does not exist: /var/www', coalesce(path, '/'))
                 WHEN 3 THEN 'Permission denied: access' WHEN 4 THEN 'caught SIGTERM, shutting down'
                 WHEN 5 THEN 'Apache configured -- resuming normal operations'
                 ELSE concat('module state ', coalesce(message, 'idle')) END)""",
        "access": f"""concat(coalesce(ip, '-'), ' - - [', date_format(ts, 'dd/MMM/yyyy:'), {clock},
            CASE WHEN k % 2 = 0 THEN ' +0000' ELSE ' +0200' END, '] "', CASE WHEN k % 3 = 0 THEN 'POST' ELSE 'GET' END,
            ' ', coalesce(path, '/'), ' HTTP/1.1" ', coalesce(status, 304), ' ', 100 + k, ' "-" "',
            CASE WHEN k % 10 = 0 THEN '' ELSE concat('agent/', k % 10) END, '"')""",
        "syslog": f"""concat(CASE WHEN k % 4 = 0 THEN '' ELSE concat('<', k, '>') END,
            date_format(ts, 'MMM d '), {clock}, ' host', user_id % 9, ' ',
            CASE k % 5 WHEN 0 THEN concat('sshd[', user_id, ']: ') WHEN 1 THEN 'cron: ' WHEN 2 THEN 'kernel '
                 WHEN 3 THEN ': ' ELSE 'su:' END, event_type, ' by ', coalesce(user, 'nobody'))""",
        "jsonl": """concat('{"', CASE WHEN k % 2 = 0 THEN '@timestamp' ELSE 'time' END, '": "',
            date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), CASE k % 3 WHEN 0 THEN 'Z' WHEN 1 THEN '+00:00' ELSE '' END,
            '", "msg": "', event_type, ' ', k, '", "', CASE WHEN k % 4 = 0 THEN 'log_level' ELSE 'level' END, '": "',
            level, '", "client_ip": ', CASE WHEN ip IS NULL THEN 'null' ELSE concat('"', ip, '"') END,
            ', "username": "', coalesce(user, ''), '", "hostname": "web-', k % 5, '", "app": "', event_type,
            '", "status": ', CASE WHEN status IS NULL THEN '"n/a"' WHEN k % 2 = 0 THEN concat('"', status, '"')
                             ELSE cast(status AS string) END,
            ', "action": "', CASE WHEN status = 401 THEN 'login_failed' ELSE 'other' END, '"',
            CASE WHEN k % 10 = 7 THEN concat(', "request_id": "r-', user_id % 50, '"') ELSE '' END, '}')""",
    }
    bad = {
        "jsonl": "CASE WHEN k % 2 = 0 THEN concat('not json ', seq) ELSE concat('[', seq, ']') END",
        "jsonl_objects": "concat('[', seq, ']')",
    }.get(kind, "concat('not a log line ', seq)")
    forms["jsonl_objects"] = forms["jsonl"]
    value = F.expr(f"CASE WHEN seq % 50 = 17 THEN '' WHEN seq % 50 = 49 THEN {bad} ELSE {forms[kind]} END")
    return once(e, "value", value).select("seq", "line_no", "value")


def normalized_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalized events that reach every kind of grouping key."""
    return as_normalized_events(log_events(spark, sf_dir))


def as_normalized_events(events: DataFrame) -> DataFrame:
    base = events.selectExpr(
        "seq",
        """CASE WHEN k = 42 THEN 'not-a-time' WHEN k = 43 THEN NULL
                ELSE concat(date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), '.',
                            lpad(cast(unix_micros(ts) % 1000000 AS string), 6, '0')) END AS timestamp""",
        "CASE WHEN user_id % 2 = 0 THEN 'generic_jsonl' ELSE 'generic_syslog' END AS source_type",
        "message AS raw_message",
        "CASE WHEN k % 8 = 0 THEN NULL ELSE 'auth' END AS event_category",
        """CASE WHEN status = 401 THEN 'login_failed' WHEN status = 200 THEN 'Login_Success'
                WHEN k % 6 = 0 THEN NULL ELSE event_type END AS event_action""",
        "CASE WHEN level = 'error' AND k % 5 = 0 THEN 'ERROR' WHEN k % 17 = 0 THEN NULL ELSE level END AS severity",
        "CASE WHEN k % 10 IN (5, 6) THEN NULL ELSE ip END AS src_ip",
        "cast(NULL AS string) AS dst_ip",
        "CASE WHEN k % 10 IN (5, 6) THEN NULL ELSE user END AS user",
        "CASE WHEN k % 4 = 3 THEN NULL ELSE concat('web-', k % 3) END AS host",
        "CASE WHEN k % 5 = 0 THEN NULL ELSE event_type END AS service",
        "status AS status_code",
        "cast(status AS string) AS status_code_raw",
        "message",
        "CASE WHEN k % 10 = 7 THEN concat('s-', user_id % 50) END AS session_hint",
        "map('apache_level', level) AS extra",
    )
    # this view's times carry microseconds always, so zero fractions are cut here
    shown = F.regexp_replace("timestamp", r"\.000000$", "")
    return base.withColumn("timestamp", shown).withColumn("event_ts", event_time(F.col("timestamp"))).select(*NORMALIZED)


def fixed_score(sessions: DataFrame) -> DataFrame:
    """A score that is a plain formula, for checking everything after scoring."""
    return sessions.withColumn(
        "anomaly_score",
        F.lit(0.3) * F.col("auth_fail_ratio") + F.lit(0.05) * F.least(F.col("event_count"), F.lit(10)) / 10,
    )
