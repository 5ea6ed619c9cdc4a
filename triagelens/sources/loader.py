"""One entry point per source kind, and mixes of several sources."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triagelens.operators.normalize import normalize_apache, normalize_ssh
from triagelens.sources import events as ev
from triagelens.sources import records as rec
from triagelens.sources.lines import scan_lines
from triagelens.sources.mapping import build_mapping, load_mapping


class LoadError(ValueError):
    """The request names an unknown source, format, file or mapping."""


@dataclass
class Loaded:
    """Good rows and quarantined lines (path, line_no, reason, raw, message)."""

    events: DataFrame
    errors: DataFrame


EVENT_PARSERS = {
    "ssh_auth": (ev.parse_ssh, ev.ssh_rejects),
    "apache_error": (ev.parse_apache_error, ev.apache_rejects),
    "access": (ev.parse_access, ev.access_rejects),
}
RECORD_FORMATS = ("jsonl", "jsonl_flat", "syslog", "syslog_simple")
SOURCE_TYPES = ("generic", "ssh", "apache")


def read_events(spark: SparkSession, path, log_type: str, year: int = 2005) -> Loaded:
    """SSH, Apache error or access log files to events for the session jobs."""
    if log_type not in EVENT_PARSERS:
        raise LoadError(f"Unsupported log_type {log_type!r}. Expected one of: {', '.join(EVENT_PARSERS)}.")
    parse, rejects = EVENT_PARSERS[log_type]
    lines = scan_lines(spark, path)
    args = {"year": year} if log_type == "ssh_auth" else {}
    return Loaded(parse(lines, **args), rejects(lines, **args))


def normalize_lines(
    lines: DataFrame, source_type: str, input_format: str = "jsonl", mapping=None, year: int = 2005
) -> Loaded:
    """Lines of one source to normalized events and quarantined lines."""
    source_type, input_format = source_type.lower(), input_format.lower()
    if source_type not in SOURCE_TYPES:
        raise LoadError(f"Unsupported source_type {source_type!r}. Expected one of: {', '.join(SOURCE_TYPES)}.")
    if source_type != "generic" and mapping is not None:
        raise LoadError("mapping is only supported when source_type='generic'")
    if source_type == "ssh":
        return Loaded(normalize_ssh(ev.parse_ssh(lines, year)), ev.ssh_rejects(lines, year))
    if source_type == "apache":
        return Loaded(normalize_apache(ev.parse_apache_error(lines)), ev.apache_rejects(lines))
    try:
        plan = build_mapping(mapping)
    except ValueError as exc:
        raise LoadError(str(exc)) from exc
    if input_format == "jsonl":
        return Loaded(rec.parse_jsonl(lines, plan), rec.jsonl_rejects(lines))
    if input_format == "jsonl_flat":
        return Loaded(rec.parse_jsonl_flat(lines, plan), rec.jsonl_rejects(lines))
    if input_format == "syslog":
        return Loaded(rec.parse_syslog(lines, plan, year), rec.syslog_rejects(lines))
    if input_format == "syslog_simple":
        return Loaded(rec.parse_syslog_simple(lines, year), rec.syslog_simple_rejects(lines, year))
    raise LoadError(
        f"Unsupported input_format {input_format!r} for source_type='generic'. "
        f"Expected one of: {', '.join(RECORD_FORMATS)}."
    )


def load_normalized(
    spark: SparkSession,
    source_type: str,
    path: str,
    input_format: str = "jsonl",
    mapping=None,
    mapping_path: str | None = None,
    year: int = 2005,
) -> Loaded:
    """Files of one source to normalized events and quarantined lines."""
    if mapping is not None and mapping_path is not None:
        raise LoadError("Pass either mapping or mapping_path, not both.")
    if mapping_path is not None:
        try:
            mapping = load_mapping(mapping_path)
        except (OSError, ValueError, RuntimeError) as exc:
            raise LoadError(f"Failed to load mapping file: {exc}") from exc
    try:
        lines = scan_lines(spark, path)
    except AnalysisException as exc:  # Spark's own file system looks for the path
        if exc.getCondition() == "PATH_NOT_FOUND":
            raise LoadError(f"Input file not found: {path}") from exc
        raise
    return normalize_lines(lines, source_type, input_format, mapping, year)


def mix(*loaded: Loaded) -> Loaded:
    """Several sources as one; ``seq`` keeps each source's order, sources in turn."""
    frames = [
        part.events.withColumn("seq", F.struct(F.lit(i).alias("source_no"), F.col("seq").alias("seq")))
        for i, part in enumerate(loaded)
    ]
    return Loaded(
        reduce(lambda a, b: a.unionByName(b), frames),
        reduce(lambda a, b: a.unionByName(b), [part.errors for part in loaded]),
    )
