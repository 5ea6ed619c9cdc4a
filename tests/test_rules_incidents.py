import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from helpers import START
from triagelens.functions import rules
from triagelens.functions.text import fixed, rounded
from triagelens.operators import evidence as ev
from triagelens.operators import incidents as inc
from triagelens.operators import ranking as rank
from triagelens.operators import reports as rep

LIT = F.lit


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_fixed_point_text_is_half_even_on_the_stored_value(spark):
    numbers = [0.125, 2.675, 0.375, 1.005, 0.285, -0.001, 66.66666666666667, 0.0705, 0.0, 1e6 + 0.005, 0.995, 9.995]
    df = spark.createDataFrame([(x,) for x in numbers], "x double")
    got = df.select("x", fixed(F.col("x"), 2).alias("two"), fixed(F.col("x"), 3).alias("three")).collect()
    assert [(r.two, r.three) for r in got] == [(f"{r.x:.2f}", f"{r.x:.3f}") for r in got]
    assert [r[0] for r in df.select(rounded(F.col("x"), 2)).collect()] == [round(x, 2) for x in numbers]


@pytest.mark.parametrize(
    "score, failed, fail_ratio, mixed, streak, burst, level, reason",
    [
        (0.30, 500, 0.96, False, 0, 0, "high", "very high failed-auth volume"),
        (0.05, 5, 0.5, False, 0, 0, "low", "limited authentication"),
        (0.3, 5000, 0.99, False, 2000, 800, "high", "extremely high failed-auth volume"),
        (0.2, 20, 0.1, True, 0, 0, "high", "failures followed by"),
        (0.15, 50, 0.7, False, 0, 0, "medium", "moderate to high"),
        (0.24, 500, 0.9, False, 0, 0, "medium", "moderate to high"),
    ],
)
def test_ssh_severity(spark, score, failed, fail_ratio, mixed, streak, burst, level, reason):
    args = [LIT(x) for x in (score, failed, fail_ratio, mixed, streak, burst)]
    assert value(spark, rules.ssh_severity(*args)) == level
    assert value(spark, rules.ssh_severity_reason(*args)).startswith(reason)


def test_ssh_confidence(spark):
    args = lambda *xs: [LIT(x) for x in xs]
    assert value(spark, rules.ssh_confidence(*args(0.32, 60, 0.9, 3, False, 0, 0))) == "high"
    assert value(spark, rules.ssh_confidence(*args(0.0, 0, 0.8, 1, False, 0, 0))) == "medium"
    assert value(spark, rules.ssh_confidence(*args(0.19, 19, 0.79, 1, False, 199, 499))) == "low"
    reason = value(spark, rules.ssh_confidence_reason(*args(0.3, 5000, 0.99, 3, False, 2000, 800)))
    assert "streak" in reason
    # high by ratio alone has no reason of its own
    assert "limited" in value(spark, rules.ssh_confidence_reason(*args(0.0, 0, 0.8, 1, False, 0, 0)))


def test_priority_table(spark):
    want = {
        ("low", "low"): (8, "low"), ("low", "medium"): (15, "low"), ("low", "high"): (21, "medium"),
        ("medium", "low"): (15, "low"), ("medium", "medium"): (30, "medium"), ("medium", "high"): (42, "medium"),
        ("high", "low"): (24, "medium"), ("high", "medium"): (48, "high"), ("high", "high"): (68, "critical"),
    }
    df = spark.createDataFrame(list(want), "s string, c string")
    score = rules.priority_score(F.col("s"), F.col("c"))
    got = {(r.s, r.c): (r.n, r.p) for r in df.select("s", "c", score.alias("n"), rules.priority_band(score).alias("p")).collect()}
    assert got == want


def test_ssh_patterns(spark):
    pattern = lambda *xs: value(spark, rules.ssh_pattern(*[LIT(x) for x in xs]))
    assert pattern(500, 0, 0.98, 3, False) == "brute_force"
    assert pattern(300, 0, 0.97, 6, False) == "password_spray"
    assert pattern(30, 2, 0.6, 1, True) == "possible_compromise"
    assert pattern(19, 0, 1.0, 1, False) == "low_signal"
    assert pattern(300, 0, 0.97, 4, False) == "suspicious_auth_activity"


APACHE = (
    "anomaly_score double, status_5xx long, error_events long, apache_5xx_burst_max_per_minute long, "
    "apache_error_burst_max_per_minute long, apache_rare_error_message_ratio double, apache_rare_path_ratio double, "
    "apache_rare_hour long, apache_high_severity_ratio double, apache_error_vs_notice_ratio double, "
    "apache_rare_error_message_count long, error_ratio double, session_id string"
)


@pytest.mark.parametrize(
    "row, pattern, levels, highlight",
    [
        ((0.25, 12, 20, 6, 12, 0.0, 0.0, 0, 0.0, 0.0, 0, 0.5), "apache_error_spike", ("medium", "medium", "medium"), "5xx responses"),
        ((0.12, 0, 4, 0, 0, 0.45, 0.40, 0, 0.0, 0.0, 2, 0.0), "apache_rare_behavior", ("low", "medium", "low"), "Rare error templates accounted for 0.45"),
        ((0.08, 0, 0, 0, 0, 0.0, 0.0, 1, 0.0, 0.0, 0, 0.0), "apache_rare_hour_activity", ("low", "low", "low"), "unusual hour"),
        ((0.05, 0, 0, 0, 0, 0.0, 0.0, 0, 0.0, 0.0, 0, 0.0), "apache_anomalous_session", ("low", "low", "low"), "without a single dominant"),
        ((0.05, 0, 9, 0, 9, 0.0, 0.0, 0, 0.1, 2.1, 0, 0.0), "apache_error_dominance", ("low", "low", "low"), "peaking at 9 per minute"),
    ],
)
def test_apache_rules(spark, row, pattern, levels, highlight):
    df = ev.classify_apache(spark.createDataFrame([(*row, "s")], APACHE))
    got = df.select("attack_pattern", "severity", "confidence", "priority", ev.apache_highlights().alias("h")).first()
    assert got.attack_pattern == pattern
    assert (got.severity, got.confidence, got.priority) == levels
    assert any(highlight in h for h in got.h)


SCORED = (
    "k_ip string, k_user string, k_agent string, session_no long, session_id string, ip string, user string, "
    "start_time timestamp, end_time timestamp, event_count long, anomaly_score double, auth_failed long, "
    "auth_success long, auth_failed_streak_max long, auth_burst_max_per_minute long"
)


def scored(spark, rows):
    """Rows of (ip, user, start minute, end minute, score, failed, success)."""
    full = []
    for i, (ip, user, start, end, score, failed, success) in enumerate(rows):
        t = lambda m: START + timedelta(minutes=m)
        full.append((ip or "", user or "", "", i, f"s{i}", ip, user, t(start), t(end), failed + success, score, failed, success, 0, 0))
    return spark.createDataFrame(full, SCORED)


def test_two_users_one_incident(spark):
    df = scored(spark, [("1.2.3.4", "user1", 0, 5, 0.30, 150, 0), ("1.2.3.4", "user2", 10, 15, 0.28, 150, 0)])
    clustered = inc.cluster_sessions(df)
    row = inc.with_member_lists(inc.roll_up(clustered), clustered).first()
    assert (row.session_count, row.auth_failed, row.auth_success, row.targeted_users) == (2, 300, 0, ["user1", "user2"])
    assert row.attack_pattern in ("brute_force", "password_spray") and row.session_ids == ["s0", "s1"]
    assert row.primary_user == "user1" and row.avg_anomaly_score == 0.29


def test_compromise_and_spray(spark):
    row = inc.ssh_incidents(scored(spark, [("5.6.7.8", "alice", 0, 5, 0.2, 40, 0), ("5.6.7.8", "alice", 10, 12, 0.2, 5, 1)])).first()
    assert (row.attack_pattern, row.auth_success, row.has_success_after_failures) == ("possible_compromise", 1, True)
    rows = [("1.2.3.4", f"u{i}", i * 10, i * 10 + 5, 0.3, 40, 0) for i in range(5)]
    row = inc.ssh_incidents(scored(spark, rows)).first()
    assert (row.attack_pattern, row.distinct_users) == ("password_spray", 5)


def test_merge_compares_with_the_session_before(spark):
    # the second session ends before the first; the third is 61 minutes after the second
    rows = [("a", "u", 0, 300, 0.1, 1, 0), ("a", "v", 10, 20, 0.1, 1, 0), ("a", "u", 81, 90, 0.1, 1, 0), (None, "u", 0, 1, 0.1, 1, 0)]
    got = inc.cluster_sessions(scored(spark, rows))
    assert {r.session_id: r.cluster_index for r in got.collect()} == {"s0": 0, "s1": 0, "s2": 1}
    exact = [("a", "u", 0, 20, 0.1, 1, 0), ("a", "u", 80, 90, 0.1, 1, 0)]
    assert inc.ssh_incidents(scored(spark, exact)).count() == 1
    kept = inc.ssh_incidents(scored(spark, rows), min_sessions=2).collect()
    assert [r.incident_id for r in kept] == ["ip:a#0"]


@pytest.mark.parametrize("seed", [4, 5])
def test_clusters_by_hour_slices_are_the_same(spark, seed):
    rng = random.Random(seed)
    rows = []
    for _ in range(300):
        start = rng.choice([rng.randrange(0, 4000), 60 * rng.randrange(0, 60)])
        rows.append((rng.choice("aab"), f"u{rng.randrange(5)}", start, start + rng.choice([0, 5, 59, 120, 400]), 0.1, 1, 0))
    df = scored(spark, rows)
    got = {r.session_id: r.cluster_index for r in inc.cluster_sessions(df).collect()}
    simple, last = {}, {}
    for r in sorted(df.collect(), key=lambda r: (r.ip, r.start_time, r.k_user, r.k_agent)):
        index, end = last.get(r.ip, (0, None))
        index += end is not None and (r.start_time - end).total_seconds() > 3600
        last[r.ip] = index, r.end_time
        simple[r.session_id] = index
    assert simple == got and max(simple.values()) > 3


def test_member_lists_are_whole(spark):
    clustered = inc.cluster_sessions(scored(spark, [("a", f"u{i}", i, i, 0.1, 1, 0) for i in range(40)]))
    row = inc.with_member_lists(inc.roll_up(clustered), clustered).first()
    assert len(row.session_ids) == 40 == inc.incident_members(clustered).count() and len(row.targeted_users) == 40


def test_filters_and_orders(spark):
    df = spark.createDataFrame(
        [("i1", "a", 0, "high", "low", "x", 0.1, 5, 0.5, 3), ("i2", "b", 0, "low", "high", "y", 0.9, 9, 0.4, 8), ("i3", "c", 0, "medium", "medium", "x", 0.5, 5, 0.5, 4)],
        "incident_id string, ip string, cluster_index int, severity string, confidence string, attack_pattern string, avg_anomaly_score double, total_events int, auth_fail_ratio double, auth_failed int",
    )
    ids = lambda d: [r.incident_id for r in d.collect()]
    assert ids(inc.sort_incidents(df)) == ["i1", "i3", "i2"]
    assert ids(inc.sort_incidents(df, "avg_score")) == ["i2", "i3", "i1"]
    assert ids(inc.sort_incidents(df, "auth_fail_ratio")) == ["i3", "i1", "i2"]
    assert ids(inc.sort_incidents(df, "total_events")) == ["i2", "i3", "i1"]
    assert ids(inc.filter_incidents(df, min_severity="medium", patterns=["x"]).orderBy("incident_id")) == ["i1", "i3"]
    assert inc.filter_incidents(df, patterns=[]).count() == 3
    assert ids(rank.nth(df, 1, inc.incident_order("avg_score"))) == ["i3"]
    with pytest.raises(ValueError):
        rank.nth(df, 3, inc.incident_order())
    with pytest.raises(ValueError):
        inc.incident_order("name")


def test_threshold_ranks(spark):
    rng = random.Random(0)
    scores = [rng.choice([0.0, 0.0, 0.0, rng.random(), 0.5]) for _ in range(500)]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(scores)], "id long, anomaly_score double")
    n = len(scores)
    want = {i: (sum(x < s for x in scores) + (sum(x == s for x in scores) + 1) / 2) / n * 100 for i, s in enumerate(scores)}
    for ranges in (1, 5):
        out = rank.add_threshold(df, threshold_percentile=90, ranges=ranges).collect()
        assert {r.id: round(r.anomaly_percentile, 9) for r in out} == {i: round(x, 9) for i, x in want.items()}
        assert all(r.is_anomalous == (r.anomaly_percentile >= 90) for r in out)
    same = spark.createDataFrame([(i, 1.0) for i in range(4)], "id long, anomaly_score double")
    assert {r.anomaly_percentile for r in rank.add_threshold(same).collect()} == {62.5}
    assert {r.n for r in rank.min_max(same, {"anomaly_score": "n"}).collect()} == {0.0}


def test_running_total_over_ranges(spark):
    df = spark.range(0, 1000).select(F.concat(F.lit("k"), F.lpad(F.col("id").cast("string"), 5, "0")).alias("k"))
    for ranges in (1, 7):
        out = rank.running_total(df, "k", F.lit(1), "before", ranges).collect()
        assert all(int(r.k[1:]) == r.before for r in out) and len(out) == 1000


def test_apache_report_and_totals(spark):
    rows = [
        (0.91, 20, 1, 7, 12, 0.40, 0.20, 3.5, "session-1", 0.5),
        (0.75, 8, 0, 2, 4, 0.10, 0.0, 1.2, "session-2", 0.1),
    ]
    df = spark.createDataFrame(
        rows,
        "ensemble_score double, error_events long, apache_rare_hour long, apache_5xx_burst_max_per_minute long, "
        "apache_error_burst_max_per_minute long, apache_rare_error_message_ratio double, apache_high_severity_ratio double, "
        "apache_error_vs_notice_ratio double, session_id string, error_ratio double",
    )
    assert rep.missing_columns(df) == [] and rep.missing_columns(df.drop("error_ratio")) == ["error_ratio"]
    report = rep.apache_report(df, 20).first()
    assert tuple(report)[:8] == (2, 1, 1, 1, 1, 1, 1, 28) and report.top_session_ids[0] == "session-1"
    assert rep.apache_report(df.limit(0), 20).first().total_sessions_considered == 0
    notes = [r[0] for r in df.select(ev.apache_summary_notes()).collect()]
    assert notes[0].count(";") == 6 and notes[1] == "no notable anomalies"
    flags = spark.createDataFrame([(True,), (True,), (False,)], "is_anomalous boolean")
    assert tuple(rep.session_totals(flags).first()) == (3, 2, 66.67)
    assert tuple(rep.session_totals(flags.limit(0)).first()) == (0, 0, 0.0)


def test_percentiles_by_rank(spark):
    import numpy as np

    from triagelens.session import lowest_hash

    rng = random.Random(7)
    values = [rng.choice([0.0, 1.0, rng.random()]) for _ in range(777)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    want = [float(np.percentile(values, p)) for p in (5, 50, 95, 100)]
    for ranges in (1, 6):
        assert np.allclose(rank.percentiles(df, "x", [0.05, 0.5, 0.95, 1.0], ranges), want)
    ids = spark.range(0, 20000, 1, 7)
    few = {r.id for r in lowest_hash(ids, ["id"], 1000).collect()}
    exact = {r.id for r in ids.orderBy(F.xxhash64(F.lit(0), "id"), "id").limit(1000).collect()}
    assert few == exact
    assert rep.score_summary(df.limit(0), "x").first().threshold_value is None
