"""Records and parsed events to the one normalized event schema."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triagelens.functions.text import blank_to_null, first_match, iso_text, once, strip
from triagelens.sources.lines import captures, group
from triagelens.sources.mapping import FieldMapping

# For each field, the record names it is read from, in order.
FIELD_ALIASES = {
    "timestamp": ["timestamp", "@timestamp", "time", "ts"],
    "message": ["message", "msg", "event_message"],
    "severity": ["severity", "level", "log_level"],
    "src_ip": ["src_ip", "source_ip", "client_ip", "ip"],
    "dst_ip": ["dst_ip", "destination_ip", "server_ip"],
    "user": ["user", "username", "account"],
    "host": ["host", "hostname", "server"],
    "service": ["service", "app", "application"],
    "event_category": ["event_category", "category", "event_type"],
    "event_action": ["event_action", "action", "operation"],
    "session_hint": ["session_hint", "session_id", "trace_id", "request_id"],
}

EVENT_FIELDS = [
    "timestamp", "source_type", "raw_message", "event_category", "event_action", "severity", "src_ip", "dst_ip",
    "user", "host", "service", "status_code", "message", "session_hint", "extra",
]
NORMALIZED = ["seq", "event_ts", "status_code_raw", *EVENT_FIELDS]

ISO_DATE_TIME = (
    r"^(\d{4}-\d{2}-\d{2})(?:[T ](\d{2}:\d{2})(?::(\d{2})(?:[.,](\d{1,6})\d*)?)?"
    r"(?:(Z)|([+-]\d{2}):?(\d{2}))?)?$"
)


# --- values of a record ----------------------------------------------------

# A record is three columns: ``plain``, a map of texts; ``texts``, an array with the text
# of each name of ``names_read``; and ``kinds``, an array beside it with their JSON types,
# null unless a text does not tell its type.  Names are looked up by place, once per line.

# Texts that mean something else as a string than as a JSON value.
TYPE_MATTERS = ["true", "false", "0", "-0", "0.0", "-0.0", "[]", "{}"]


def names_read(mapping: FieldMapping | None) -> list[str]:
    """Every name a record is asked for, by its place."""
    names = [a for aliases in FIELD_ALIASES.values() for a in aliases] + ["status_code", "raw_message"]
    if mapping:
        names += [n for target, listed in mapping.fields.items() for n in (target, *listed)] + list(mapping.defaults)
    return list(dict.fromkeys(names))


def needs_types(texts: Column, mapping: FieldMapping | None) -> Column:
    """Whether a name that is read has a text whose JSON type matters."""
    names = names_read(mapping)
    status = ["status_code", *(mapping.fields.get("status_code", []) if mapping else [])]
    odd = F.arrays_overlap(texts, F.array(*[F.lit(t) for t in TYPE_MATTERS]))
    for name in status:
        odd = F.coalesce(odd, F.lit(False)) | F.coalesce(F.get(texts, F.lit(names.index(name))).rlike("[.eE]"), F.lit(False))
    return odd


def _text(plain: Column, kind: Column) -> Column:
    """Strings as they are, the rest as JSON, but for the case of booleans."""
    return F.when(kind == "BOOLEAN", F.initcap(plain)).otherwise(plain)


def _present(plain: Column, kind: Column) -> Column:
    """Whether a value counts as given: not null, empty, zero or false."""
    return (
        F.when(plain.isNull(), False)
        .when(kind == "STRING", plain != "")
        .when(kind == "BOOLEAN", plain == "true")
        .when(kind.startswith("ARRAY"), plain != "[]")
        .when(kind.startswith("OBJECT"), plain != "{}")
        .otherwise(F.coalesce(plain.try_cast("double") != 0, F.lit(True)))
    )


def _pairs(items: dict[str, Column]) -> Column:
    return F.create_map(*[x for name, value in items.items() for x in (F.lit(name), value)])


def _replace(df: DataFrame, column: str, value: Column) -> DataFrame:
    return once(df, "_new", value).drop(column).withColumnRenamed("_new", column)


def _with_given(df: DataFrame) -> DataFrame:
    """Adds ``given``, the texts of the values that count as given, and shows ``texts``."""
    typed = F.col("kinds").isNotNull()
    out = once(
        df,
        "given",
        F.when(
            typed, F.zip_with("texts", "kinds", lambda v, k: F.when(_present(v, k), _text(v, k)))
        ).otherwise(F.transform("texts", lambda v: F.nullif(v, F.lit("")))),
    )
    return _replace(out, "texts", F.when(typed, F.zip_with("texts", "kinds", _text)).otherwise(F.col("texts")))


# --- mapping ----------------------------------------------------------------


def _default(part: str, value) -> Column:
    """A default of the mapping: its text, its text if it counts as given, or its type."""
    if part == "kinds":
        return F.schema_of_variant(F.parse_json(F.lit(json.dumps(value))))
    shown = value if value is None or isinstance(value, str) else str(value) if isinstance(value, bool) else json.dumps(value)
    return F.lit(shown if part == "texts" or value else None).cast("string")


def _mapped(df: DataFrame, mapping: FieldMapping | None, flat: bool) -> DataFrame:
    """``texts``, ``given`` and ``kinds`` with mapped fields over defaults over the record's
    own names, and ``hidden``, the own names that are not seen any more, and ``loose``, what
    the mapping adds under names that are no first name of a field.

    A default applies only where the name is absent; a source name is skipped when absent or
    null, but an empty text is taken.  In the flat form each target is its first source name,
    null included.
    """
    if mapping is None:
        return df.withColumns({"hidden": F.array().cast("array<string>"), "loose": F.lit(None).cast("map<string,string>")})
    names = names_read(mapping)
    place = {n: i for i, n in enumerate(names)}
    at = lambda part, n: F.get(part, F.lit(place[n]))
    first, defaults = mapping.first_names(), {} if flat else mapping.defaults
    absent = lambda n: ~F.map_contains_key("plain", F.lit(n))
    taken = lambda n: F.lit(True) if flat else F.coalesce(*[at("texts", s) for s in mapping.fields[n]]).isNotNull()

    def value(part: str, n: str) -> Column:
        if flat:
            return at(part, first.get(n, n))
        out = F.when(absent(n), _default(part, defaults[n])).otherwise(at(part, n)) if n in defaults else at(part, n)
        for source in reversed(mapping.fields.get(n, [])):
            out = F.when(at("texts", source).isNotNull(), at(part, source)).otherwise(out)
        return out

    always_read = {aliases[0] for aliases in FIELD_ALIASES.values()} | {"status_code"}
    loose = [n for n in dict.fromkeys([*mapping.fields, *defaults]) if n not in always_read]
    put = {n: taken(n) if n in first else F.lit(False) for n in loose}
    added = {n: (put[n] | absent(n)) if n in defaults else put[n] for n in loose}
    out = once(
        df,
        "_m",
        F.struct(
            *[F.array(*[value(part, n) for n in names]).alias(part) for part in ("texts", "given")],
            F.when(F.col("kinds").isNotNull(), F.array(*[value("kinds", n) for n in names])).alias("kinds"),
            F.array_compact(F.array(*[F.when(put[n], F.lit(n)) for n in loose])).cast("array<string>").alias("hidden"),
            _kept_map({n: (added[n], value("texts", n)) for n in loose}).alias("loose"),
        ),
    )
    return out.select("seq", "plain", "_m.*")


def _kept_map(items: dict[str, tuple[Column, Column]]) -> Column:
    """Map of the names whose condition holds; null values are kept."""
    if not items:
        return F.lit(None).cast("map<string,string>")
    entries = F.array(*[F.struct(F.lit(n).alias("key"), v.alias("value"), c.alias("kept")) for n, (c, v) in items.items()])
    return F.map_from_entries(
        F.transform(F.filter(entries, lambda e: e["kept"]), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value")))
    )


# --- time -------------------------------------------------------------------


def with_iso_timestamp(df: DataFrame, raw: Column) -> DataFrame:
    """Adds ``timestamp``: ISO text in one form where ``raw`` is an ISO time,
    other text unchanged; and ``event_ts``: its instant, null for other text."""
    out = once(df, "_text", blank_to_null(raw))
    out = once(out, "_iso", captures(F.col("_text"), ISO_DATE_TIME, 7))
    date, clock, second, fraction, zulu, zone_hour, zone_minute = [group("_iso", i) for i in range(1, 8)]
    whole = F.concat(
        date,
        F.lit("T"),
        F.when(clock == "", "00:00").otherwise(clock),
        F.lit(":"),
        F.when(second == "", "00").otherwise(second),
    )
    micros = F.rpad(fraction, 6, "0")
    shown = F.concat(
        whole,
        F.when((fraction == "") | (micros == "000000"), "").otherwise(F.concat(F.lit("."), micros)),
        F.when(zulu != "", "+00:00").when(zone_hour != "", F.concat(zone_hour, F.lit(":"), zone_minute)).otherwise(""),
    )
    real = F.try_to_timestamp(whole, F.lit("yyyy-MM-dd'T'HH:mm:ss")).isNotNull()
    out = once(out, "_shown", F.when(real, shown))
    return out.select(
        *df.columns,
        F.coalesce("_shown", "_text").alias("timestamp"),
        F.col("_shown").try_cast("timestamp").alias("event_ts"),
    )


def event_time(iso: Column) -> Column:
    """Instant of an ISO text (no zone is read as UTC); null for other text."""
    return F.when(iso.rlike(ISO_DATE_TIME), iso.try_cast("timestamp"))


# --- record to event --------------------------------------------------------


def _read_names(aliases: list[str], given) -> list[Column]:
    """The names read for one field: up to the first with a value, else all."""
    names = [F.lit(aliases[0])]
    missing = F.lit(True)
    for before, alias in zip(aliases, aliases[1:]):
        missing = missing & given(before).isNull()
        names.append(F.when(missing, F.lit(alias)))
    return names


def from_record(df: DataFrame, source_type: str, mapping: FieldMapping | None = None, flat: bool = False) -> DataFrame:
    """Read the event fields of a record; what is left becomes ``extra``.

    Names are used up to the first one with a value; the later ones stay in
    ``extra``.  If none has a value the last one counts as read.
    """
    names = names_read(mapping)
    record = _mapped(_with_given(df.select("seq", "plain", "texts", "kinds")), mapping, flat)
    text = lambda n: F.get("texts", F.lit(names.index(n)))
    given = lambda n: F.get("given", F.lit(names.index(n)))
    fields = {
        name: F.coalesce(*[given(a) for a in aliases], text(aliases[-1])) for name, aliases in FIELD_ALIASES.items()
    }
    used = [name for aliases in FIELD_ALIASES.values() for name in _read_names(aliases, given)]
    picked = once(
        record.select(
            "seq",
            "plain",
            "hidden",
            "loose",
            F.coalesce(F.get("kinds", F.lit(names.index("status_code"))), F.lit("STRING")).alias("status_kind"),
            *[value.alias(name) for name, value in fields.items()],
            F.array_compact(F.array(*used, F.lit("status_code"))).alias("read"),
            text("status_code").alias("status_code_raw"),
            text("raw_message").alias("raw_message"),
        ),
        "used",
        F.concat("read", "hidden"),
    )
    left = F.map_filter("plain", lambda k, v: ~F.array_contains("used", k))
    if mapping is not None:
        left = F.map_concat(
            left, F.coalesce(F.map_filter("loose", lambda k, v: ~F.array_contains("read", k)), F.map_from_arrays(*[F.array().cast("array<string>")] * 2))
        )
    raw = F.col("status_code_raw")
    status = (
        F.when(F.col("status_kind") == "BOOLEAN", F.when(raw == "True", 1).otherwise(0))
        .when(F.col("status_kind") == "STRING", strip(raw).try_cast("int"))
        .otherwise(raw.try_cast("double").try_cast("int"))
    )
    timed = with_iso_timestamp(picked.withColumnRenamed("timestamp", "raw_time"), F.col("raw_time"))
    return timed.select(
        "seq",
        "event_ts",
        "status_code_raw",
        "timestamp",
        F.lit(source_type).alias("source_type"),
        blank_to_null(F.coalesce("raw_message", "message")).alias("raw_message"),
        *[blank_to_null(F.col(name)).alias(name) for name in FIELD_ALIASES if name != "timestamp"],
        status.alias("status_code"),
        left.alias("extra"),
    ).select(*NORMALIZED)


# --- parsed events to normalized events -------------------------------------


def _clean(name: str) -> Column:
    return blank_to_null(F.col(name))


def _extra(**fields: Column) -> Column:
    return F.map_filter(_pairs(fields), lambda k, v: v.isNotNull())


def ssh_action(status: Column, raw: Column) -> Column:
    text = F.lower(raw)
    status = F.coalesce(status, F.lit(-1))
    return first_match(
        [
            ((status == 401) | text.contains("failed password"), "login_failed"),
            ((status == 200) | text.contains("accepted password"), "login_success"),
            (text.contains("accepted publickey"), "login_success"),
            (text.contains("invalid user"), "invalid_user"),
            (text.contains("maximum authentication attempts exceeded"), "auth_attempts_exceeded"),
            (text.contains("connection closed"), "connection_closed"),
            (text.contains("disconnect"), "disconnect"),
        ],
        "ssh_event",
    )


def ssh_severity_of(action: Column) -> Column:
    return F.when(action.isin("login_failed", "invalid_user", "auth_attempts_exceeded"), "warn").otherwise("info")


def session_hint(ip: Column, user: Column) -> Column:
    return F.coalesce(F.concat(ip, F.lit("|"), user), ip, user)


def normalize_ssh(events: DataFrame) -> DataFrame:
    raw = F.coalesce(_clean("raw"), F.lit(""))
    base = events.select(
        "seq", "ts", "status", raw.alias("raw"), _clean("ip").alias("ip"), _clean("user").alias("user"),
        _extra(method=_clean("method"), path=_clean("path"), user_agent=_clean("user_agent")).alias("extra"),
    )
    base = once(base, "action", ssh_action(F.col("status"), F.col("raw")))
    return _event_rows(
        base,
        source_type=F.lit("ssh"),
        raw_message=F.col("raw"),
        event_category=F.lit("auth"),
        event_action=F.col("action"),
        severity=ssh_severity_of(F.col("action")),
        src_ip=F.col("ip"),
        user=F.col("user"),
        service=F.lit("ssh"),
        status_code=F.col("status"),
        message=F.col("raw"),
        session_hint=session_hint(F.col("ip"), F.col("user")),
        extra=F.col("extra"),
    )


# Apache level groups.
APACHE_ERROR_LEVELS = ["emerg", "alert", "crit", "critical", "error"]
APACHE_WARN_LEVELS = ["warn", "warning"]
APACHE_NOTICE_LEVELS = ["notice", "info", "debug"]


def apache_severity_of(level: Column) -> Column:
    level = F.lower(strip(level))
    return F.when(level.isin(APACHE_ERROR_LEVELS), "error").when(level.isin(APACHE_WARN_LEVELS), "warn").otherwise("info")


def apache_action(level: Column, message: Column) -> Column:
    text, level = F.lower(message), F.lower(strip(level))
    return first_match(
        [
            (text.contains("segmentation fault"), "process_crash"),
            (text.contains("client denied"), "access_denied"),
            (text.contains("file does not exist"), "missing_file"),
            (text.contains("permission denied"), "permission_denied"),
            (text.contains("caught sigterm") | text.contains("shutting down"), "service_shutdown"),
            (text.contains("resuming normal operations"), "service_start"),
            (level.isin(APACHE_ERROR_LEVELS), "apache_error"),
            (level.isin(APACHE_WARN_LEVELS), "apache_warn"),
            (level.isin(APACHE_NOTICE_LEVELS), "apache_notice"),
        ],
        "apache_event",
    )


def normalize_apache(events: DataFrame) -> DataFrame:
    base = events.select(
        "seq", "ts",
        F.coalesce(_clean("raw"), F.lit("")).alias("raw"),
        _clean("message").alias("message"),
        _clean("level").alias("level"),
        F.coalesce(_clean("source"), F.lit("apache_error")).alias("source"),
    ).withColumn("message", F.coalesce("message", "raw"))
    return _event_rows(
        base,
        source_type=F.lit("apache"),
        raw_message=F.col("raw"),
        event_category=F.lit("application"),
        event_action=apache_action(F.col("level"), F.col("message")),
        severity=apache_severity_of(F.col("level")),
        service=F.lit("apache"),
        message=F.col("message"),
        extra=_extra(apache_level=F.col("level"), parser_source=F.col("source")),
    )


def _event_rows(base: DataFrame, **fields: Column) -> DataFrame:
    fields = {
        "timestamp": iso_text(F.col("ts")),
        "event_ts": F.col("ts"),
        "status_code_raw": fields.get("status_code", F.lit(None)).cast("string"),
        **fields,
    }
    types = {"status_code": "int", "extra": "map<string,string>"}
    out = [F.col("seq")]
    for name in NORMALIZED[1:]:
        if name in fields:
            out.append(fields[name].alias(name))
        else:
            out.append(F.lit(None).cast(types.get(name, "string")).alias(name))
    return base.select(*out)
