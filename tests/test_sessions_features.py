import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from helpers import brute_features, event, events
from triagelens.operators import features as feat
from triagelens.operators import sessions as sess


def features(spark, rows, **options):
    return feat.session_features(events(spark, rows), **options)


def test_gap_is_open_at_exactly_thirty_minutes(spark):
    rows = [event(1, 0, "1.1.1.1", "a"), event(2, 1800, "1.1.1.1", "a"), event(3, 3600.000001, "1.1.1.1", "a")]
    got = sess.sessionize(events(spark, rows)).orderBy("seq").collect()
    assert [r.session_no for r in got] == [0, 0, 1]
    assert got[2].session_id == "1.1.1.1||a||2024-01-01T11:00:00.000001"


def test_null_and_empty_are_one_identity_and_agent_splits(spark):
    rows = [event(1, 0), event(2, 1, "", ""), event(3, 2, agent="x")]
    got = {r.seq: (r.k_agent, r.session_no) for r in sess.sessionize(events(spark, rows)).collect()}
    assert got == {1: ("", 0), 2: ("", 0), 3: ("x", 0)}
    assert sess.session_table(events(spark, rows)).count() == 2


def test_success_after_failure(spark):
    statuses = [401, 401, 401, 200, 200, 200, 404, 500, 401, 200, 200]
    row = features(spark, [event(i, i * 40, "1.1.1.1", "a", s) for i, s in enumerate(statuses)]).first()
    assert row.success_after_failure_count == 5
    assert row.auth_failed_streak_max == 3 and row.auth_fail_ratio == 4 / 9


def test_apache_features(spark):
    rows = [event(i, i, status=200, path="/health", level="notice", message="OK", source="apache") for i in range(3)]
    rows += [event(3 + i, 10 + i, status=500, path="/api/error", level="error", message=f"rare-error-{i}", source="apache") for i in range(5)]
    row = features(spark, rows).first()
    assert (row.status_5xx, row.apache_5xx_streak_max, row.error_events, row.notice_events) == (5, 5, 5, 3)
    assert row.apache_error_vs_notice_ratio == 5 / 3 and row.apache_5xx_burst_max_per_minute == 5
    assert row.apache_distinct_message_templates == 6 and row.apache_rare_error_message_count == 5
    assert row.apache_rare_path_ratio == 0.0 and row.unique_paths == 2
    assert set(feat.NUMERIC_FEATURES) <= set(row.asDict())


def test_identity_baselines(spark):
    rows, seq = [], 0
    for start, n, ip, user in ((0, 2, "1.1.1.1", "alice"), (7200, 4, "1.1.1.1", "alice"), (14400, 8, "1.1.1.1", "alice"), (0, 3, "2.2.2.2", "bob")):
        for i in range(n):
            seq += 1
            rows.append(event(seq, start + i, ip, user))
    got = {(r.user, r.event_count): r for r in features(spark, rows).collect()}
    assert [got[("alice", n)].first_seen_ip_flag for n in (2, 4, 8)] == [1, 0, 0]
    assert (got[("alice", 2)].rare_seen_ip_flag, got[("bob", 3)].rare_seen_ip_flag) == (0, 1)
    assert got[("alice", 8)].ip_events_per_session == pytest.approx(14 / 3)
    assert got[("alice", 2)].user_events_per_session_deviation == pytest.approx(2 - 14 / 3)
    assert (got[("bob", 3)].ip_events_per_session, got[("bob", 3)].ip_events_per_session_deviation) == (3.0, 0.0)


def test_closed_window_and_rare_hour(spark):
    row = features(spark, [event(1, 0, "a"), event(2, 60, "a"), event(3, 120.000001, "a")]).first()
    assert row.auth_burst_max_per_minute == 2
    night = features(spark, [event(1, -9 * 3600, "a"), event(2, -9 * 3600 + 1, "a")]).first()
    assert night.ssh_rare_hour == 1
    with pytest.raises(ValueError):
        feat.session_features(events(spark, [event(1, 0)]), gap_minutes=1, window_seconds=61)


def test_peaks_of_a_dense_minute_are_spread(spark):
    """100,000 instants of one identity in a minute: no task holds them all."""
    rng = np.random.default_rng(5)
    us = np.unique(np.concatenate([rng.integers(0, 60_000_000, 100_000), 60_000_000 + rng.integers(0, 60_000_000, 2_000)]))
    status = rng.choice([404, 500, 200], len(us))
    base = 1_704_103_200_000_000  # a whole minute
    frame = pd.DataFrame({"us": us + base, "status": status})
    rows = spark.createDataFrame(frame).selectExpr(
        "'a' AS k_ip", "'' AS k_user", "'' AS k_agent", "us", "us div 60000000 AS slice", "cast(status AS int) AS status", "'error' AS level"
    )
    settings = {"spark.sql.shuffle.partitions": "8", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {name: spark.conf.get(name) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        step = 7745  # floor of the root of 60,000,000
        pieces = feat._move_summaries(feat._moves(rows, 60_000_000), step).where("at_slice = {}".format(base // 60_000_000))
        per_task = [r[0] for r in pieces.groupBy(F.spark_partition_id()).count().select("count").collect()]
        got = {r.slice - base // 60_000_000: r for r in feat._peak_rates(rows, 60).collect()}
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert len(per_task) == 8 and max(per_task) < sum(per_task) / 4
    assert len(us) > 101_000 and set(got) == {0, 1}
    for name, hit in (("all", status > 0), ("404", status == 404), ("5xx", status == 500), ("error", status > 0)):
        at = us[hit]  # windows may end at any event of the slice
        held = np.searchsorted(at, us, "right") - np.searchsorted(at, us - 60_000_000, "left")
        assert [int(held[us // 60_000_000 == n].max()) for n in (0, 1)] == [got[n][f"peak_{name}"] for n in (0, 1)]


def test_events_before_1970(spark):
    far = -1_704_103_200  # 10:00 of the helper's day is this far from the epoch
    rows = [event(i, far + (i - 3) * 20, "a", status=401) for i in range(6)]
    row = features(spark, rows).first()
    assert (row.event_count, row.auth_burst_max_per_minute, row.auth_failed_streak_max) == (6, 4, 6)


def _random_rows(seed, n=600):
    rng = random.Random(seed)
    rows, t = [], 0.0
    for seq in range(n):
        t += rng.choice([0, 0, 0, 1, 5, 30, 59.5, 60, 200, 1800, 1801])
        ip = rng.choice(["hot"] * 6 + ["b", None])
        rows.append(
            event(seq, t, ip, rng.choice(["u", None]), rng.choice([401, 401, 401, 200, 500, 404, None]),
                  level=rng.choice(["error", "notice", None]))
        )
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_a_plain_walk(spark, seed):
    rows = _random_rows(seed)
    want = brute_features(rows)
    got = features(spark, rows, parts=("rates",)).collect()
    table = {
        ((r.k_ip, r.k_user, r.k_agent), r.start_time.timestamp()): (
            r.event_count, r.auth_failed_streak_max, r.apache_5xx_streak_max, r.success_after_failure_count,
            r.auth_burst_max_per_minute, r.apache_404_burst_max_per_minute, r.apache_error_burst_max_per_minute,
            round(r.max_inter_event_gap_seconds, 6),
        )
        for r in got
    }
    assert table == want


def test_same_result_for_any_number_of_partitions(spark):
    rows, seen = _random_rows(3), []
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        df = features(spark, rows).select("session_id", *feat.NUMERIC_FEATURES)
        seen.append(sorted(map(tuple, df.collect())))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen[0] == seen[1]
