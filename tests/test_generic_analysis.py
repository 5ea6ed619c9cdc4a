import json

import pytest
from pyspark.sql import functions as F

from helpers import event, events
from triagelens.functions import wording as w
from triagelens.operators import analysis as ana
from triagelens.operators import evidence as ev
from triagelens.operators import generic_incidents as gen
from triagelens.operators import normalize as norm
from triagelens.operators import reports as rep
from triagelens.sources import records as rec


def jsonl(lines, *objects):
    return rec.parse_jsonl(lines(*[json.dumps(o) for o in objects]))


def test_three_auth_events_make_two_incidents(lines):
    base = {"user": "alice", "src_ip": "10.0.0.1", "event_action": "login_failed"}
    df = jsonl(lines, *[{"timestamp": f"2026-05-13T10:{m}:00Z", **base} for m in ("00", "03", "20")])
    rows = gen.generic_incidents(df).orderBy(*gen.generic_order()).collect()
    assert [(r.incident_id, r.event_count, r.bucket) for r in rows] == [
        ("generic:src_ip_user:10.0.0.1|alice#1", 2, "2026-05-13T10:00:00+00:00"),
        ("generic:src_ip_user:10.0.0.1|alice#2", 1, "2026-05-13T10:15:00+00:00"),
    ]
    assert rows[0].attack_pattern == "auth_fail_burst" and rows[0].last_seen == "2026-05-13T10:03:00+00:00"


def test_buckets(lines):
    df = jsonl(
        lines,
        {"ts": "2024-01-01T01:50:09"}, {"ts": "2024-01-01T01:50:09+05:30"}, {"ts": "soon"}, {"ts": "2024-02-30T00:00:00"}, {"user": "x"},
    )
    pick = lambda m: [r[0] for r in df.orderBy("seq").select(gen.clock_bucket(m)).collect()]
    assert pick(45) == ["2024-01-01T01:45:00", "2024-01-01T01:45:00+05:30", "no_time", "no_time", "no_time"]
    assert pick(90)[0] == "2024-01-01T01:00:00"
    epoch = gen.with_group(df, 90, mode="epoch").orderBy("seq").first()
    assert epoch.bucket == "2024-01-01T01:30:00"
    for bad in (0, 1441):
        with pytest.raises(ValueError):
            gen.with_group(df, bad)


def test_group_keys(lines):
    full = {"session_hint": "h", "src_ip": "i", "user": "u", "host": "o", "service": "s"}
    order = ["session_hint:h", "src_ip_user:i|u", "user:u", "host_service:o|s", "service:s", "unknown"]
    names = list(full)
    objects = [full]
    for drop in (1, 2, 3, 4, 5):
        objects.append({k: full[k] for k in names[drop:]})
    got = [r.group_key for r in gen.with_group(jsonl(lines, *objects)).orderBy("seq").collect()]
    assert got == order
    more = jsonl(lines, {"src_ip": "i"}, {"host": "o"})
    assert [r.group_key for r in gen.with_group(more).orderBy("seq").collect()] == ["src_ip:i", "host:o"]


def test_generic_levels_and_sets(lines):
    severities = ["error", "ERROR", "critical", "crit", "warn", "Warning"]
    df = jsonl(lines, *[{"ts": "2024-01-01T00:00:00", "user": "u", "host": f"h{i % 2}", "severity": s} for i, s in enumerate(severities)])
    row = gen.generic_incidents(df).first()
    assert (row.error_count, row.warning_count, row.distinct_hosts) == (2, 2, 2)  # "critical" is not "error"
    assert (row.severity, row.confidence, row.priority) == ("medium", "medium", "medium")
    assert row.summary_title == "Medium generic incident for user:u"
    assert "across 1 user(s), 2 host(s), and 0 source IP(s)" in row.summary_description


def test_numbering_in_ranges(lines):
    df = jsonl(lines, *[{"ts": "2024-01-01T00:00:00", "user": f"u{i:03d}"} for i in range(200)])
    assert {r.incident_id for r in gen.generic_incidents(df).collect()} == {f"generic:user:u{i:03d}#{i + 1}" for i in range(200)}


def test_evidence_of_epoch_buckets(lines):
    objects = [{"ts": f"2024-01-01T0{i}:20:00", "user": "u", "event_action": "x"} for i in range(9)] * 3
    df = jsonl(lines, *objects)
    incidents = gen.generic_incidents(df, 90, "epoch")
    assert ev.generic_evidence(incidents, df, window_minutes=90, mode="epoch").count() == incidents.count() == 6
    whole = ev.normalized_evidence(incidents, df, "generic", "jsonl", 90, "epoch")
    assert sum(len(r.events) for r in whole.collect()) == 27


def test_evidence_in_blocks(lines):
    objects = [{"ts": "2024-01-01T00:20:00", "user": f"u{i % 2}", "event_action": f"a{i}"} for i in range(23)]
    df = jsonl(lines, *objects)
    incidents = gen.generic_incidents(df)
    whole = {r.incident.incident_id: r.events for r in ev.normalized_evidence(incidents, df, "generic", "jsonl").collect()}
    rows = ev.evidence_blocks(incidents, df, size=5).orderBy("incident_id", "block").collect()
    assert [(r.block, len(r.events)) for r in rows] == [(0, 5), (1, 5), (2, 2), (0, 5), (1, 5), (2, 1)]
    assert {i: [e for r in rows if r.incident_id == i for e in r.events] for i in whole} == whole


def test_adapters(spark):
    rows = [
        event(1, 0, "203.0.113.10", "admin", 401), event(2, 1, "203.0.113.11", "deploy", 200, path="/x", agent="ssh"),
        event(3, 2, level="error", message="File does not exist: /var/www/a", source="apache_error"),
        event(4, 3, level="notice", message="Apache -- resuming normal operations", source="apache_error"),
    ]
    base = events(spark, rows).withColumn("raw", F.coalesce("message", F.lit("Accepted publickey for deploy"))).withColumn("method", F.lit(None).cast("string"))
    a, b = norm.normalize_ssh(base.where("seq <= 2")).orderBy("seq").collect()
    assert (a.event_action, a.severity, a.event_category, a.service, a.session_hint, a.extra) == (
        "login_failed", "warn", "auth", "ssh", "203.0.113.10|admin", {},
    )
    assert (b.event_action, b.severity, b.extra) == ("login_success", "info", {"path": "/x", "user_agent": "ssh"})
    c, d = norm.normalize_apache(base.where("seq > 2")).orderBy("seq").collect()
    assert (c.event_action, c.severity, c.extra) == ("missing_file", "error", {"apache_level": "error", "parser_source": "apache_error"})
    assert (d.event_action, d.severity) == ("service_start", "info")
    counts = {(r.dimension, r.value): r.n for r in rep.ssh_summary(norm.normalize_ssh(base.where("seq <= 2")), approximate=True).collect()}
    assert counts[("distinct_users", "all")] == 2 and counts[("severity", "warn")] == 1


def test_playbooks(spark):
    pairs = [("brute_force", "high"), ("password_spray", "low"), ("possible_compromise", "high"), ("possible_compromise", "low"), ("other", "high"), ("low_signal", "low")]
    df = ana.with_playbook(spark.createDataFrame(pairs, "attack_pattern string, severity string"))
    got = {(r.attack_pattern, r.severity): r.playbook and r.playbook.slug for r in df.collect()}
    assert list(got[p] for p in pairs) == [
        "ssh_bruteforce_medium", "ssh_password_spray_medium", "ssh_possible_compromise_high", None, None, "ssh_low_signal_background",
    ]


def test_generic_evidence_and_analysis(lines):
    objects = [{"ts": f"2024-01-01T00:0{i}:00", "session_hint": "s", "src_ip": "" if i == 0 else f"10.0.0.{i}", "event_action": "login_failed"} for i in range(7)]
    df = jsonl(lines, *objects)
    incidents = gen.generic_incidents(df)
    evidence = ev.generic_evidence(incidents, df)
    row = evidence.first()
    assert len(row.sessions) == 5 and row.ip == "10.0.0.1" and row.user is None
    assert row.sessions[0].session_id == "s" and row.sessions[0].auth_failed == 1
    assert row.sessions[0].notes == ["severity=unknown", "service=unknown", "host=unknown"]
    out = ana.analyse(evidence, ana.generic_payload()).first()
    assert out.hypothesis == w.HYPOTHESES["auth_fail_burst"] and out.playbook_slug is None
    assert out.caveats == [w.CAVEAT_VOLUME, w.CAVEAT_USER, w.CAVEAT_GENERIC, w.CAVEAT_SCOPE]
    assert out.next_steps == w.GENERIC_STEPS and "Sample normalized events included: 5." in out.evidence
    payload = json.loads(evidence.select(ana.payload_json(ana.generic_payload())).first()[0])
    assert payload["incident"]["primary_user"] is None and payload["aggregates"]["window_minutes"] == 15
    whole = ev.normalized_evidence(incidents, df, "generic", "jsonl")
    shaped = json.loads(whole.select(ana.payload_json(ana.structured_payload(2))).first()[0])
    assert shaped["total_event_count"] == 7 and shaped["sampled_event_count"] == 2


GOOD = {"summary": "s", "evidence": ["a"], "hypothesis": "h", "caveats": [], "next_steps": ["n"], "playbook_slug": None, "playbook_notes": "x"}


@pytest.mark.parametrize(
    "change, problem",
    [
        ({}, None),
        ({"extra": 1}, None),
        ({"summary": None}, "AI analysis 'summary' must be a string."),
        ({"evidence": "x"}, "AI analysis 'evidence' must be a list of strings."),
        ({"caveats": [1]}, "AI analysis 'caveats' must contain only strings."),
        ({"next_steps": ["a", None]}, "AI analysis 'next_steps' must contain only strings."),
        ({"playbook_notes": 3}, "AI analysis 'playbook_notes' must be a string or None."),
    ],
)
def test_analysis_check(spark, change, problem):
    df = spark.createDataFrame([(json.dumps({**GOOD, **change}),)], "payload string")
    assert ana.check_analysis(df).first().problem == problem


def test_analysis_check_shape(spark):
    missing = json.dumps({k: v for k, v in GOOD.items() if k != "caveats"})
    df = spark.createDataFrame([(missing,), ("[]",), ("nope",)], "payload string")
    assert [r.problem for r in ana.check_analysis(df).collect()] == [
        "AI analysis is missing required key: 'caveats'", "AI analysis must be a dict.", "AI analysis must be a dict.",
    ]


def test_nan_becomes_null(spark):
    df = spark.createDataFrame([("s", "i", "u", 1, float("nan"), 0.5)], "session_id string, ip string, user string, event_count long, error_ratio double, anomaly_score double")
    assert ev.session_rows(df).first().error_ratio is None


def test_score_summaries_of_many_runs(spark):
    """A thousand runs at once, one with a third of all rows, some without scores."""
    import random

    import numpy as np

    from triagelens.operators import reports

    rng = random.Random(6)
    rows = [(0, rng.choice([None, 0.5, rng.random()])) for _ in range(4000)] + [(i, round(rng.random(), 2)) for i in range(1, 999) for _ in range(1 + i % 17)] + [(999, None)]
    scored = spark.createDataFrame(rows, "run long, anomaly_score double").repartition(5)
    got = {r.run: r for r in reports.score_summaries(scored, "run").collect()}
    assert len(got) == 1000
    for run, r in got.items():
        x = np.array([s for i, s in rows if i == run and s is not None])
        if not len(x):
            assert r.score_min is None and r.threshold_value is None
            continue
        threshold = np.percentile(x, 99)
        assert np.allclose([r.score_min, r.score_max, r.score_mean, r.score_p95, r.threshold_value], [x.min(), x.max(), x.mean(), np.percentile(x, 95), threshold], atol=1e-12)
        assert abs(r.fraction_above_threshold - (x >= r.threshold_value).mean()) < 1e-12


def test_optional_part_without_a_library(tmp_path):
    """Where a library that only the training-data operators need is missing, the rest registers."""
    import os
    import subprocess
    import sys

    root = os.path.join(os.path.dirname(__file__), "..")
    code = "import sys; sys.modules['ahocorasick'] = None; import __spark_entry__ as e; print(len(e.queries()), len(e.ENTRIES), any(q.startswith('op') for q in e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=120)
    count, core, llm = out.stdout.split()
    assert count == core and llm == "False"
