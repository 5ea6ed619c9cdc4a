"""JSON-lines and syslog lines to records, then to normalized events.

A record is a map of texts and, by place, the texts of the names that are read; where the
type of a value matters (false and zero count as absent, the texts "false" and "0" do not)
also its JSON type.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from triagelens.functions.text import blank_to_null, iso_text, once, strip
from triagelens.operators.normalize import from_record, names_read, needs_types
from triagelens.sources.lines import captures, group, is_blank, quarantine
from triagelens.sources.mapping import build_mapping

# Syslog line patterns.
SYSLOG_LINE = (
    r"(?dU)^(?:<(\d{1,3})>)?([A-Z][a-z]{2}\s{1,2}\d{1,2}\s\d{2}:\d{2}:\d{2})\s+(\S+)\s+(.*?)\s*$"
)
SYSLOG_TAG = r"(?dU)^([A-Za-z0-9_.\-/]+)(?:\[(\d+)\])?(?::\s*|\s+)?(.*)$"
SYSLOG_SIMPLE = r"(?dU)^(?:<(\d+)>)?([A-Z][a-z]{2}\s{1,2}\d{1,2}\s\d{2}:\d{2}:\d{2})\s+(\S+)\s+(.*)$"
# Severity names by code 0..7, full and short form.
SEVERITY_NAMES = ["emergency", "alert", "critical", "error", "warn", "notice", "info", "debug"]
SEVERITY_SHORT = ["emerg", "alert", "crit", "error", "warning", "notice", "info", "debug"]

RECORD = "map<string,variant>"


def severity_name(pri: Column, names: list[str]) -> Column:
    table = F.array(*[F.lit(n) for n in names])
    return F.get(table, (pri % 8).cast("int"))


def facility(pri: Column) -> Column:
    return F.floor(pri / 8).cast("bigint")


# --- JSON lines -----------------------------------------------------------


# Bare NaN and infinities, which some writers put into JSON, outside of strings: what
# follows them must be complete strings and other characters up to the end.
BARE = r"(?<=[:\[,\s])(-?){name}(?=\s*[,}}\]](?:[^\"\\]++|\\.|\"(?:[^\"\\]++|\\.)*+\")*+$)"


def _as_array(value: Column) -> Column:
    return F.concat(F.lit("["), value, F.lit("]"))


def _readable(value: Column) -> Column:
    """``value`` with bare NaN and infinities as the texts nan and inf, if that is what
    keeps it from being JSON."""
    plain = value
    for name, shown in (("NaN", "nan"), ("Infinity", "inf")):
        plain = F.regexp_replace(plain, BARE.format(name=name), f'"$1{shown}"')
    odd = F.rlike(value, F.lit("NaN|Infinity")) & F.try_parse_json(_as_array(value)).isNull()
    return F.when(odd, plain).otherwise(value)


def _last_wins(entries: Column) -> Column:
    """The map with the last value of every key."""
    keys = F.map_keys(entries)
    pairs = F.map_entries(entries)
    last = F.filter(pairs, lambda e, i: F.array_position(F.reverse(keys), e["key"]) == F.size(keys) - i)
    return F.when(F.size(keys) == F.size(F.array_distinct(keys)), entries).otherwise(F.map_from_entries(last))


def _kind(doc: Column) -> Column:
    """JSON type of the only item of an array, or "invalid"."""
    single = F.try_variant_get(doc, "$[0]", "variant").isNotNull() & F.try_variant_get(doc, "$[1]", "variant").isNull()
    shape = F.regexp_extract(F.schema_of_variant(doc), r"^ARRAY<([A-Z]+)", 1)
    return F.when(single, shape).otherwise("invalid")


def _typed(lines: DataFrame) -> DataFrame:
    """Adds ``json`` (the line as JSON), ``doc`` (it, parsed) and ``kind`` (its JSON
    type, or "invalid").

    The line is parsed as the only item of an array, so text after a complete
    value is an error too.
    """
    readable = once(lines, "json", _readable(F.col("value")))
    typed = once(readable, "doc", F.try_parse_json(_as_array(F.col("json"))))
    return once(typed, "kind", _kind(F.col("doc")))


# What try_parse_json reads, and no more.
STRICT = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}


def _objects(lines: DataFrame, mapping) -> DataFrame:
    """Non-blank lines as records; ``plain`` is null unless the line is one JSON object.

    A line is read as a map of all names and as a struct of the names that are read, which
    are then found by place; its types are read only where they matter.
    """
    names = names_read(mapping)
    out = once(lines.where(~is_blank(F.col("value"))), "json", _readable(F.col("value")))
    out = once(out, "items", F.from_json(_as_array(F.col("json")), "array<map<string,string>>", STRICT))
    fields = T.StructType([T.StructField(n, T.StringType()) for n in names])
    single = F.size("items") == 1
    out = once(out, "plain", F.when(single, _last_wins(F.get("items", F.lit(0)))))
    out = once(out, "named", F.when(F.col("plain").isNotNull(), F.from_json("json", fields, STRICT)))
    # names may differ by case alone, so fields are taken by their place
    at = [f"n{i}" for i in range(len(names))]
    kept = [*lines.columns, "json", "plain"]
    out = out.select(*kept, "named.*").toDF(*kept, *at)
    out = once(out, "texts", F.array(*at)).select(*kept, "texts")
    typed = F.expr(f"try_variant_get(try_parse_json(concat('[', json, ']')), '$[0]', '{RECORD}')")
    kinds = F.transform_values(typed, lambda k, v: F.schema_of_variant(v))
    out = once(out, "types", F.when(needs_types(F.col("texts"), mapping), kinds))
    known = F.transform(F.array(*[F.lit(n) for n in names]), lambda n: F.try_element_at("types", n))
    return once(out, "kinds", F.when(F.col("types").isNotNull(), known)).drop("json", "types")


def parse_jsonl(lines: DataFrame, mapping=None) -> DataFrame:
    """One object per line; each field takes the first of its mapped names that is not null."""
    plan = build_mapping(mapping)
    good = _objects(lines, plan).where(F.col("plain").isNotNull())
    source_type = (plan.source_type if plan else None) or "generic_jsonl"
    return from_record(good, source_type, plan)


def parse_jsonl_flat(lines: DataFrame, mapping=None) -> DataFrame:
    """First name only, and its null is kept; an invalid line fails the job."""
    plan = build_mapping(mapping)
    message = F.concat(F.lit("invalid JSON line: "), F.col("value"))
    parsed = F.try_parse_json(_as_array(_readable(F.col("value"))))
    strict = once(
        _objects(lines, plan),
        "checked",
        F.when(F.col("plain").isNotNull(), True)
        .when(_kind(parsed) == "invalid", F.raise_error(message).cast("boolean"))
        .otherwise(False),
    )
    return from_record(strict.where("checked"), "generic_jsonl", plan, flat=True)


def jsonl_rejects(lines: DataFrame) -> DataFrame:
    kind = F.col("kind")
    # How the type of a non-object line is named.
    named = (
        F.when(kind == "ARRAY", "list")
        .when(kind == "STRING", "str")
        .when(kind == "BOOLEAN", "bool")
        .when(kind == "BIGINT", "int")
        .when(kind == "VOID", "NoneType")
        .otherwise("float")
    )
    reason = F.when(kind == "invalid", F.lit("invalid JSON")).when(
        kind != "OBJECT", F.concat(F.lit("expected JSON object, got "), named)
    )
    why = F.when(is_blank(F.col("value")), None).otherwise(reason)
    return quarantine(_typed(lines).select(*lines.columns, why.alias("_why")), F.col("_why"))


# --- syslog ---------------------------------------------------------------


def _record(**fields: Column) -> Column:
    return F.create_map(*[x for name, value in fields.items() for x in (F.lit(name), value.cast("string"))])


def _as_record(df: DataFrame, plain: Column, mapping=None) -> DataFrame:
    """Syslog values are texts and positive numbers: their types never matter."""
    out = once(df, "plain", plain)
    texts = F.array(*[F.try_element_at("plain", F.lit(n)) for n in names_read(mapping)])
    return once(out, "texts", texts).withColumn("kinds", F.lit(None).cast("array<string>"))


def syslog_time(text: Column, year: int) -> Column:
    """``Mon D HH:MM:SS`` in ``year``; runs of blanks count as one."""
    return F.try_to_timestamp(
        F.concat(F.lit(f"{year} "), F.regexp_replace(text, r"(?U)\s+", " ")), F.lit("yyyy MMM d H:m:s")
    )


def _syslog(lines: DataFrame) -> DataFrame:
    return once(lines.where(~is_blank(F.col("value"))), "m", captures(F.col("value"), SYSLOG_LINE, 4))


def parse_syslog(lines: DataFrame, mapping=None, year: int = 2005) -> DataFrame:
    """RFC 3164 lines: priority, tag and pid are split off; times are UTC."""
    plan = build_mapping(mapping)
    matched = _syslog(lines).where(group("m", 2).isNotNull())
    parts = once(
        matched.withColumn("msg", strip(group("m", 4))), "tag", captures(strip(group("m", 4)), SYSLOG_TAG, 3)
    ).select(
        "*",
        F.nullif(group("m", 1), F.lit("")).try_cast("int").alias("pri"),
        syslog_time(group("m", 2), year).alias("at"),
    )
    content = blank_to_null(group("tag", 3))
    when_ = F.coalesce(F.concat(iso_text(F.col("at")), F.lit("+00:00")), strip(group("m", 2)))
    base = _record(
        timestamp=when_,
        host=group("m", 3),
        raw_message=F.col("value"),
        severity=severity_name(F.col("pri"), SEVERITY_NAMES),
        event_category=F.lit("syslog"),
        message=F.coalesce(content, "msg"),
        service=group("tag", 1),
        pid=F.nullif(group("tag", 2), F.lit("")),
        pri=F.col("pri"),
        facility=facility(F.col("pri")),
    )
    # no pid or priority means no such name; no severity means a null one
    optional = ["service", "pid", "pri", "facility"]
    kept = F.map_filter(base, lambda k, v: v.isNotNull() | ~k.isin(optional))
    source_type = (plan.source_type if plan else None) or "generic_syslog"
    return from_record(_as_record(parts, kept, plan), source_type, plan)


def syslog_rejects(lines: DataFrame) -> DataFrame:
    reason = F.when(
        ~is_blank(F.col("value")) & group(captures(F.col("value"), SYSLOG_LINE, 4), 2).isNull(),
        "failed to parse syslog line (line does not match RFC3164-style syslog format)",
    )
    return quarantine(once(lines, "_why", reason), F.col("_why"))


def _simple(lines: DataFrame, year: int) -> DataFrame:
    parts = once(lines.withColumn("text", strip(F.col("value"))), "m", captures(strip(F.col("value")), SYSLOG_SIMPLE, 4))
    return once(parts, "at", syslog_time(group("m", 2), year))


def parse_syslog_simple(lines: DataFrame, year: int = 2005) -> DataFrame:
    """The text before the first colon is the service; times are naive."""
    parts = _simple(lines, year).where(F.col("at").isNotNull()).select(
        "seq",
        "at",
        F.nullif(group("m", 1), F.lit("")).try_cast("bigint").alias("pri"),
        group("m", 3).alias("host"),
        group("m", 4).alias("body"),
        F.instr(group("m", 4), ":").alias("colon"),
    )
    has_colon = F.col("colon") > 0
    record = _record(
        timestamp=iso_text(F.col("at")),
        host=F.col("host"),
        message=F.when(has_colon, strip(F.expr("substr(body, colon + 1)"))).otherwise(F.col("body")),
        severity=severity_name(F.col("pri"), SEVERITY_SHORT),
        service=F.when(has_colon, blank_to_null(F.expr("substr(body, 1, colon - 1)"))),
        facility=facility(F.col("pri")),
    )
    return from_record(_as_record(parts, record), "generic_jsonl")


def syslog_simple_rejects(lines: DataFrame, year: int = 2005) -> DataFrame:
    reason = F.when((F.col("text") != "") & F.col("at").isNull(), "could not parse syslog line")
    return quarantine(_simple(lines, year).select(*lines.columns, reason.alias("_why")), F.col("_why"))
