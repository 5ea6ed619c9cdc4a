"""SSH auth, Apache error and web access lines to the event schema.

Each parser maps a frame with ``value`` (one line) and ``seq`` (order) to events;
lines that do not match, or whose time is not a real one, go to ``*_rejects``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triagelens.functions.text import empty_to_null, extract, once, strip
from triagelens.sources.lines import captures, group, is_blank, quarantine

# Line patterns.  (?dU) gives "." and the classes the meaning the
# results depend on: only a newline ends a line, and classes cover Unicode.
SSH_LINE = r"(?dU)^(\w{3})\s+(\d{1,2})\s+(\d{2}:\d{2}:\d{2})\s+(\S+)\s+(\S+):\s+(.*)$"
IP_TOKEN = r"(?dU)\b(\d{1,3}(?:\.\d{1,3}){3})\b"
USER_TOKEN = r"(?dU)user (\S+)"
APACHE_LINE = r"(?dU)^\[([^\]]+)\]\s+\[([^\]]+)\]\s+(.*)$"
APACHE_TIME = r"(?diU)^(?:mon|tue|wed|thu|fri|sat|sun)\s+(\w{3})\s+(\d{1,2})\s+(\d{1,2}:\d{1,2}:\d{1,2})\s+(\d{4})$"
ACCESS_LINE = r'(?dU)^(\S+) \S+ \S+ \[([^\]]+)\] "(\S+) (\S+) \S+" (\d{3}) \S+ ".*" "(.*)".*$'

EVENT_COLUMNS = [
    "seq", "ts", "ip", "user", "method", "path", "status", "user_agent", "raw", "source", "level", "message",
]


def month_day_time(year: Column, month: Column, day: Column, clock: Column) -> Column:
    shown = F.concat(year, F.lit(" "), month, F.lit(" "), day, F.lit(" "), clock)
    return F.try_to_timestamp(shown, F.lit("yyyy MMM d H:m:s"))


def _events(df: DataFrame, **columns: Column) -> DataFrame:
    empty = {
        "ip": "string", "user": "string", "method": "string", "path": "string", "status": "int",
        "user_agent": "string", "level": "string", "message": "string",
    }
    out = []
    for name in EVENT_COLUMNS:
        if name in columns:
            out.append(columns[name].alias(name))
        elif name in empty:
            out.append(F.lit(None).cast(empty[name]).alias(name))
        else:
            out.append(F.col(name))
    return df.select(*out)


def _ssh(lines: DataFrame, year: int) -> DataFrame:
    parts = once(lines, "m", captures(F.col("value"), SSH_LINE, 6))
    at = month_day_time(F.lit(str(year)), group("m", 1), group("m", 2), group("m", 3))
    return once(parts, "ts", at).withColumn("text", group("m", 6))


def auth_status(text: Column) -> Column:
    return F.when(text.contains("Failed password"), 401).when(text.contains("Accepted password"), 200)


def parse_ssh(lines: DataFrame, year: int = 2005) -> DataFrame:
    text = F.col("text")
    return _events(
        _ssh(lines, year).where(F.col("ts").isNotNull()),
        ip=extract(text, IP_TOKEN, 1),
        user=extract(text, USER_TOKEN, 1),
        status=auth_status(text).cast("int"),
        raw=F.col("value"),
        source=F.lit("ssh_auth"),
    )


def ssh_rejects(lines: DataFrame, year: int = 2005) -> DataFrame:
    return _rejects(_ssh(lines, year), "no SSH line match", lines.columns)


def _apache(lines: DataFrame) -> DataFrame:
    parts = once(lines, "m", captures(F.col("value"), APACHE_LINE, 3))
    timed = once(parts, "t", captures(group("m", 1), APACHE_TIME, 4))
    return once(timed, "ts", month_day_time(group("t", 4), group("t", 1), group("t", 2), group("t", 3)))


def parse_apache_error(lines: DataFrame) -> DataFrame:
    return _events(
        _apache(lines).where(F.col("ts").isNotNull()),
        raw=F.col("value"),
        source=F.lit("apache_error"),
        level=strip(group("m", 2)),
        message=strip(group("m", 3)),
    )


def apache_rejects(lines: DataFrame) -> DataFrame:
    return _rejects(_apache(lines), "no Apache line match", lines.columns)


def _access(lines: DataFrame) -> DataFrame:
    parts = once(lines, "m", captures(F.col("value"), ACCESS_LINE, 6))
    return once(parts, "ts", F.try_to_timestamp(group("m", 2), F.lit("dd/MMM/yyyy:HH:mm:ss Z")))


def parse_access(lines: DataFrame) -> DataFrame:
    return _events(
        _access(lines).where(F.col("ts").isNotNull()),
        ip=group("m", 1),
        method=group("m", 3),
        path=group("m", 4),
        status=group("m", 5).cast("int"),
        user_agent=empty_to_null(group("m", 6)),
        raw=F.col("value"),
        source=F.lit("access"),
    )


def access_rejects(lines: DataFrame) -> DataFrame:
    return _rejects(_access(lines), "no access line match", lines.columns)


def _rejects(parsed: DataFrame, no_match: str, keep: list[str]) -> DataFrame:
    reason = (
        F.when(is_blank(F.col("value")), None)
        .when(group("m", 1).isNull(), no_match)
        .when(F.col("ts").isNull(), "not a valid time")
    )
    return quarantine(parsed.select(*keep, reason.alias("_why")), F.col("_why"))
