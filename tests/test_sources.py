import json

import pytest

from triagelens.sources import events as src
from triagelens.sources import loader
from triagelens.sources import records as rec
from triagelens.sources.lines import number_lines, quarantine, scan_lines
from triagelens.sources.mapping import build_mapping, load_mapping
from pyspark.sql import functions as F


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def test_ssh_line(lines):
    row = one(
        src.parse_ssh(
            lines(
                "Dec 10 06:55:48 edge7 sshd[812]: Failed password for invalid user carla from 198.51.100.23 port 50122 ssh2"
            )
        )
    )
    assert str(row.ts) == "2005-12-10 06:55:48"
    assert (row.ip, row.user, row.status, row.source) == ("198.51.100.23", "carla", 401, "ssh_auth")


def test_ssh_rejects_bad_month_and_text(lines):
    frame = lines("Xyz 10 06:55:48 h p: m", "", "junk", "Feb 30 06:55:48 h p: m")
    assert src.parse_ssh(frame).count() == 0
    assert [(r.line_no, r.reason) for r in src.ssh_rejects(frame).orderBy("line_no").collect()] == [
        (1, "not a valid time"), (3, "no SSH line match"), (4, "not a valid time"),
    ]


def test_apache_lines(lines):
    frame = lines(
        "[Thu Jun 09 06:07:04 2005] [notice] cache: shared memory segment attached", "not a valid apache error line", "",
        "[Thu Jun 09 06:07:05 2005] [error] proxy: no worker left for the pool",
    )
    rows = src.parse_apache_error(frame).orderBy("seq").collect()
    assert [(r.level, r.message) for r in rows] == [
        ("notice", "cache: shared memory segment attached"), ("error", "proxy: no worker left for the pool"),
    ]
    assert rows[0].user_agent is None and str(rows[0].ts) == "2005-06-09 06:07:04"


def test_access_line_is_utc(lines):
    row = one(
        src.parse_access(
            lines('10.0.0.5 - - [14/Mar/2026:22:55:10 +0200] "POST /login HTTP/1.1" 401 234 "-" "curl/7.68.0"')
        )
    )
    assert (str(row.ts), row.ip, row.method, row.path, row.status, row.user_agent) == (
        "2026-03-14 20:55:10", "10.0.0.5", "POST", "/login", 401, "curl/7.68.0",
    )


MULTI = {
    "fields": {
        "timestamp": ["@timestamp"], "message": ["msg"], "severity": ["level"], "src_ip": ["client_ip"],
        "user": ["username"], "service": ["app", "application"], "event_action": ["event_type", "action"],
        "event_category": ["category"], "status_code": ["status"], "session_hint": ["request_id"], "host": ["hostname"],
    }
}


def test_jsonl_mapping_takes_first_name_with_a_value(lines):
    frame = lines(
        json.dumps({"@timestamp": "2026-05-13T12:00:00Z", "app": "auth-service", "event_type": "login_failed", "request_id": "req-123"}),
        json.dumps({"@timestamp": "2026-05-13T12:01:00Z", "application": "orders", "action": "timeout", "status": "504", "hostname": "web-01"}),
    )
    first, second = rec.parse_jsonl(frame, MULTI).orderBy("seq").collect()
    assert (first.timestamp, first.service, first.event_action, first.session_hint) == (
        "2026-05-13T12:00:00+00:00", "auth-service", "login_failed", "req-123",
    )
    assert (second.host, second.service, second.event_action, second.status_code) == ("web-01", "orders", "timeout", 504)


def test_jsonl_defaults_and_null_names(lines):
    frame = lines('{"level": null, "log_level": "warn", "event_category": null, "category": "c"}', '{"category": "c"}')
    mapping = {"source_type": "x", "fields": {"severity": ["level", "log_level"]}, "defaults": {"event_category": "auth"}}
    first, second = rec.parse_jsonl(frame, mapping).orderBy("seq").collect()
    assert (first.severity, first.event_category, first.source_type) == ("warn", "c", "x")  # key was there: no default
    assert (second.event_category, second.extra) == ("auth", {"category": "c"})


def test_jsonl_types_decide_what_counts_as_given(lines):
    frame = lines(
        '{"severity": 0, "level": "low", "user": false, "username": "u"}',
        '{"severity": "0", "user": "false", "status_code": 504.7}',
        '{"status_code": "5.0", "message": "m", "raw_message": null, "ts": "2024-01-01 10:00"}',
    )
    a, b, c = rec.parse_jsonl(frame).orderBy("seq").collect()
    assert (a.severity, a.user) == ("low", "u")
    assert (b.severity, b.user, b.status_code) == ("0", "false", 504)
    assert (c.status_code, c.status_code_raw, c.raw_message, c.timestamp) == (None, "5.0", "m", "2024-01-01T10:00:00")


def test_flat_mapping_keeps_null_and_fails_on_bad_json(lines):
    flat = {"timestamp": "ts", "src_ip": "client_ip", "user": "user_name", "status_code": "status", "message": "log_message", "severity": "level"}
    good = '{"ts": "t", "client_ip": "203.0.113.10", "user_name": "alice", "status": 401, "level": "warning", "message": "own"}'
    row = one(rec.parse_jsonl_flat(lines(good, "[1]"), flat))
    assert (row.src_ip, row.user, row.status_code, row.severity, row.message) == ("203.0.113.10", "alice", 401, "warning", None)
    with pytest.raises(Exception, match="invalid JSON line"):
        rec.parse_jsonl_flat(lines(good, "nope"), flat).collect()


def test_jsonl_errors(lines):
    frame = lines('{"a": 1}', "", "nope", "[1]", "3", '"s"', "null", '{"a": 1}x', "true", "1.5")
    got = [(r.line_no, r.reason) for r in rec.jsonl_rejects(frame).orderBy("line_no").collect()]
    assert got == [
        (3, "invalid JSON"), (4, "expected JSON object, got list"), (5, "expected JSON object, got int"),
        (6, "expected JSON object, got str"), (7, "expected JSON object, got NoneType"), (8, "invalid JSON"),
        (9, "expected JSON object, got bool"), (10, "expected JSON object, got float"),
    ]


def test_syslog_forms(lines):
    frame = lines(
        "<34>Oct 11 22:14:15 myhost su: failed login for root",
        "Oct 11 22:14:15 myhost sshd[1234]: Accepted password for alice",
        "not a syslog line",
    )
    a, b = rec.parse_syslog(frame, year=2024).orderBy("seq").collect()
    assert (a.host, a.service, a.severity, a.event_category, a.extra["facility"]) == ("myhost", "su", "critical", "syslog", "4")
    assert (b.service, b.extra["pid"], b.message, b.timestamp) == (
        "sshd", "1234", "Accepted password for alice", "2024-10-11T22:14:15+00:00",
    )
    a, b = rec.parse_syslog_simple(frame, 2024).orderBy("seq").collect()
    assert (a.severity, a.service, b.service, b.timestamp) == ("crit", "su", "sshd[1234]", "2024-10-11T22:14:15")
    errors = rec.syslog_simple_rejects(frame, 2024).collect()
    assert [e.message for e in errors] == ["line 3: could not parse syslog line"]


def test_mapping_checks(tmp_path):
    assert build_mapping({"a": "x", "b": ["y", " "]}).fields == {"a": ["x"], "b": ["y"]}
    for bad in ([], {"fields": []}, {"fields": {"a": 1}}, {"fields": {"a": []}}, {"fields": {}, "defaults": []}):
        with pytest.raises(ValueError):
            build_mapping(bad)
    path = tmp_path / "m.json"
    path.write_text(json.dumps({"fields": {"user": ["u"]}, "defaults": {"host": "h"}}))
    loaded = load_mapping(str(path))
    assert loaded.first_names() == {"user": "u"} and loaded.defaults == {"host": "h"}
    (tmp_path / "m.txt").write_text("")
    with pytest.raises(ValueError):
        load_mapping(str(tmp_path / "m.txt"))
    with pytest.raises(FileNotFoundError):
        load_mapping(str(tmp_path / "none.json"))


def test_loader_checks(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_text('{"user": "a"}\n\nnope\n')
    got = loader.load_normalized(spark, "generic", str(path))
    assert got.events.count() == 1
    assert [e.message for e in got.errors.collect()] == ["line 3: invalid JSON"]
    for args, kwargs in [
        (("other", str(path)), {}), (("generic", str(path), "xml"), {}), (("generic", str(tmp_path / "no")), {}),
        (("generic", str(path)), {"mapping": {}, "mapping_path": "x"}), (("ssh", str(path)), {"mapping": {"a": "b"}}),
    ]:
        with pytest.raises(loader.LoadError):
            loader.load_normalized(spark, *args, **kwargs)


def test_line_numbers_over_many_splits(spark, tmp_path):
    for name, n in (("a.log", 5000), ("b.log", 1234)):
        (tmp_path / name).write_text("".join(f"{name} line {i}\n" if i % 7 else "\n" for i in range(1, n + 1)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        scanned = scan_lines(spark, str(tmp_path))
        assert scanned.rdd.getNumPartitions() > 5
        rows = number_lines(scanned).collect()
        assert len(rows) == 6234
        assert all(int(r.value.split()[-1]) == r.line_no for r in rows if r.value)
        reason = F.when(F.col("value").endswith(" 1000"), "marked")
        assert {r.line_no for r in quarantine(scanned, reason).collect()} == {1000}
        ordered = [r.value for r in scanned.where("value like 'a.log%'").orderBy("seq").collect()]
        assert [int(x.split()[-1]) for x in ordered] == sorted(int(x.split()[-1]) for x in ordered)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_json_lines_with_repeated_keys_and_bare_numbers(lines):
    df = rec.parse_jsonl(
        lines(
            '{"user":"a","user":"b","msg":"m"}',
            '{"msg": "x: NaN, y", "score": NaN, "low":-Infinity, "user": "c"}',
            '{"msg": "quote \\" NaN, ", "user": Infinity}',
            '{"msg": NaN "user": 1}',
        )
    )
    rows = {r.seq: r for r in df.collect()}
    assert rows[0].user == "b" and rows[1].user == "c" and rows[1].message == "x: NaN, y"
    assert rows[1].extra["score"] == "nan" and rows[1].extra["low"] == "-inf"
    assert rows[2].user == "inf" and rows[2].message == 'quote " NaN,' and 3 not in rows


def test_mapped_names_that_are_no_first_name_of_a_field(lines):
    mapping = {
        "fields": {"User": ["who", "USER"], "msg": ["text"], "severity": ["lvl"]},
        "defaults": {"region": "eu", "note": None, "severity": "info", "host": False, "retries": 3},
    }
    frame = lines(
        '{"who": "a", "user": "own", "text": "t", "lvl": null, "ok": true, "n": [1, {"b": 2}]}',
        '{"USER": "b", "region": null, "msg": "kept", "severity": "", "retries": 0}',
        "{}",
    )
    a, b, c = rec.parse_jsonl(frame, mapping).orderBy("seq").collect()
    # a null source leaves the default; a false default does not count as given
    assert (a.user, a.message, a.severity, a.host) == ("own", "t", "info", None)
    assert a.extra == {
        "who": "a", "User": "a", "text": "t", "lvl": None, "ok": "true", "n": '[1,{"b":2}]', "region": "eu", "note": None, "retries": "3",
    }
    assert (b.message, b.severity) == ("kept", None)
    assert b.extra == {"USER": "b", "User": "b", "region": None, "note": None, "retries": "0"}
    assert c.extra == {"region": "eu", "note": None, "retries": "3"} and c.severity == "info"


def test_flat_mapping_of_other_names_and_empty_mapping(lines):
    frame = lines('{"a": 1, "Team": "own", "x": "m"}', '{"a": null}')
    one_, two = rec.parse_jsonl_flat(frame, {"Team": "a", "message": "x"}).orderBy("seq").collect()
    assert one_.message == "m" and one_.extra == {"a": "1", "x": "m", "Team": "1"}
    assert two.extra == {"a": None, "Team": None}
    for parse in (rec.parse_jsonl, rec.parse_jsonl_flat):
        assert [r.extra for r in parse(frame, {"fields": {}}).orderBy("seq").collect()] == [
            {"a": "1", "Team": "own", "x": "m"}, {"a": None}
        ]


def test_only_whole_objects_are_records(lines):
    frame = lines('{"a": 1} ', '{"a": 1}x', '{"a": 1}, {"b": 2}', "{'a': 1}", '[{"a": 1}]', "null", '{"a": 01}', '{"a": "b', '{"user": "  \\u00a0"}')
    got = rec.parse_jsonl(frame).orderBy("seq").collect()
    assert [(r.seq, r.extra, r.user) for r in got] == [(0, {"a": "1"}, None), (8, {}, None)]
