"""What keeps the time of large inputs down, and that it changes no result."""

import random

import numpy as np
from pyspark.sql import functions as F

from helpers import brute_features, event, events
from triagelens.catalog import ENTRIES
from triagelens.functions.text import once
from triagelens.models import detectors, jobs, kernels, vectors
from triagelens.operators import evidence as ev
from triagelens.operators import features as feat
from triagelens.operators import generic_incidents as gen
from triagelens.operators import ranking as rank
from triagelens.plans import bridge
from triagelens.session import stage

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_lambdas_are_outside_of_generators(spark):
    df = once(spark.range(3), "x", F.transform(F.array("id"), lambda v: v + 1))
    generators = [line for line in plan(df).splitlines() if "Generate explode" in line]
    assert generators and not any("lambda" in line for line in generators)
    assert [r.x for r in df.where("x[0] > 1").orderBy("id").collect()] == [[2], [3]]


def test_rows_of_one_row_group_are_dealt(spark):
    assert bridge.table(spark, SF, "events").rdd.getNumPartitions() == 1
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert bridge.lines_of(spark, SF, "jsonl").rdd.getNumPartitions() == n


def test_payloads_make_no_lists_of_sessions(spark):
    for name in ("ssh_payload_values", "ssh_incident_analysis"):
        assert "collect_list" not in plan(ENTRIES[name].run(spark, SF))


def _sessions(spark):
    rng = random.Random(1)
    rows = [event(i, i * 700, f"10.0.0.{i % 7}", f"u{i % 11}", rng.choice([200, 401, 404])) for i in range(400)]
    return stage(feat.session_features(events(spark, rows)), "features")


def test_training_rows_are_scored_once(spark):
    features = _sessions(spark)
    for kind in ("iforest", "ocsvm"):
        model = detectors.fit(features, kind)
        key = lambda r: (r.k_ip, r.k_user, r.session_no, r.anomaly_score)
        kept = jobs.training_scores(features, model)
        assert "ArrowEvalPython" not in plan(kept)
        assert sorted(map(key, kept.collect())) == sorted(map(key, jobs.score_sessions(features, model).collect()))


def test_mean_path_of_more_points_than_a_part():
    rng = np.random.default_rng(4)
    points = rng.normal(size=(5000, 3))
    points[7, 1] = np.nan
    rows = sorted(kernels.grow_tree(points[100:164], rng))
    names = ["node", "feature", "threshold", "left", "right", "length"]
    columns = {n: np.array([r[i] for r in rows]) for i, n in enumerate(names)}
    tree = detectors._trees({**columns, "tree": np.zeros(len(rows), int)})[0]

    def walk(point):
        at = 0
        while columns["feature"][at] >= 0:
            at = columns["left" if point[columns["feature"][at]] <= columns["threshold"][at] else "right"][at]
        return columns["length"][at]

    assert np.array_equal(kernels.mean_path(points, [tree, tree], 64), np.array([walk(p) for p in points]))


def test_features_are_worked_on_by_session_number(spark):
    rows = [event(i, i * 700, f"10.0.0.{i % 3}", None, 401, path=f"/{i % 4}") for i in range(40)]
    lines = plan(feat.session_features(events(spark, rows))).splitlines()
    windows = [line for line in lines if "Window [" in line or "Window(" in line]
    assert windows and not any("k_ip" in line for line in windows)
    assert not any("collect_set" in line for line in lines)


def test_sources_and_values_of_sessions(spark):
    names = ["a", "b", "", None, "c", "a"]
    rows = [event(i, i, "1.1.1.1", "x", 401, path="/p", source=names[i]) for i in range(6)]
    rows += [event(9, 1, "2.2.2.2", "y", 200, path="/once", message="/p", source=None)]
    got = {r.ip: r for r in feat.session_features(events(spark, rows)).collect()}
    assert [(got[ip].source_count, got[ip].has_mixed_sources) for ip in ("1.1.1.1", "2.2.2.2")] == [(3, 1), (0, 0)]
    assert [(got[ip].unique_paths, got[ip].apache_rare_path_ratio) for ip in got if ip == "2.2.2.2"] == [(1, 1.0)]
    assert got["1.1.1.1"].apache_rare_path_ratio == 0.0 and got["2.2.2.2"].apache_rare_error_message_count == 1


def test_sessions_that_part_within_a_window_keep_their_own_peaks(spark):
    rng = random.Random(6)
    rows, at = [], 0.0
    for i in range(300):
        at += rng.choice([0, 0, 1, 30, 60, 60.000001, 61])
        rows.append(event(i, at, rng.choice("ab"), "u", rng.choice([401, 404, 500, 200, None]), level=rng.choice(["error", "notice"])))
    table = {
        ((r.k_ip, r.k_user, r.k_agent), r.start_time.timestamp()): (
            r.event_count, r.auth_failed_streak_max, r.apache_5xx_streak_max, r.success_after_failure_count,
            r.auth_burst_max_per_minute, r.apache_404_burst_max_per_minute, r.apache_error_burst_max_per_minute,
            round(r.max_inter_event_gap_seconds, 6),
        )
        for r in feat.session_features(events(spark, rows), gap_minutes=1, parts=("rates",)).collect()
    }
    assert table == brute_features(rows, gap=60)


def test_feature_statistics_are_grouped_by_place(spark):
    features = _sessions(spark)
    stats = vectors.feature_stats(features)
    keys = [line for line in plan(stats).splitlines() if "HashAggregate(keys=" in line]
    assert keys and all("keys=[place#" in line for line in keys)
    found = {r.feature: r for r in stats.collect()}
    assert set(found) == set(feat.NUMERIC_FEATURES)
    table = features.select(*feat.NUMERIC_FEATURES).toPandas().astype(float)
    for name, row in found.items():
        want = [table[name].mean(), table[name].std(ddof=0), table[name].min(), table[name].max()]
        assert np.allclose([row["mean"], row["deviation"], row["low"], row["high"]], want)


def test_rows_are_dealt_once_for_their_numbers(spark):
    values = random.Random(2).sample(range(1000), 300)
    df = spark.createDataFrame([(f"{v:03d}", v) for v in values], "k string, v int").repartition(5)
    for ranges in (1, 3, 7):
        out = rank.numbered(df, F.concat(F.lit("x"), "k"), "no", ranges)
        assert "Exchange hashpartitioning" not in plan(out.select("k", "v", "no")).split("BroadcastExchange")[0]
        assert [(r.v, r.no) for r in out.orderBy("no").collect()] == [(v, i + 1) for i, v in enumerate(sorted(values))]
        assert out.columns == ["k", "v", "no"]


def test_events_are_dealt_in_blocks_of_neighbours(spark, monkeypatch):
    monkeypatch.setattr(bridge, "BLOCK", 50)
    dealt = bridge.events_in_blocks(spark, SF)
    assert dealt.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = dealt.select((F.col("seq") / 50).cast("int").alias("b"), F.spark_partition_id().alias("p")).distinct()
    assert blocks.groupBy("b").count().where("count > 1").isEmpty() and blocks.select("p").distinct().count() > 1
    assert sorted(dealt.collect(), key=lambda r: r.seq) == bridge.log_events(spark, SF).orderBy("seq").collect()


def _normalized(spark):
    """Groups of up to 40 events, some without ip, user, time, hint or message."""
    rng = random.Random(3)
    pick = lambda *names: rng.choice([None, "", *names])
    schema = "seq long, timestamp string, source_type string, event_category string, event_action string, severity string, src_ip string, " \
        "dst_ip string, user string, host string, service string, status_code int, message string, session_hint string"
    rows = [
        (i, f"2024-01-01T00:{rng.randrange(60):02d}:00" if i % 9 else None, rng.choice("ab"), pick("c"), pick("login_failed", "LOGIN_SUCCESS"),
         pick("error"), pick("1.1.1.1", "2.2.2.2"), None, pick("u", "v"), pick("h"), pick("s"), None, f"m{i}", pick("x", "y"))
        for i in rng.sample(range(5000), 900)
    ]
    return spark.createDataFrame(rows, schema).withColumn("event_ts", F.to_timestamp("timestamp")).repartition(6)


def test_first_events_of_incidents_are_listed_in_input_order(spark):
    grouped = stage(gen.with_group(_normalized(spark)), "grouped")
    assert gen.with_group(grouped) is grouped
    incidents = gen.generic_incidents(grouped, more=gen.first_names())
    evidence = ev.generic_evidence(incidents, grouped)
    lines = plan(evidence)
    # no list is made by an aggregation, ip and user come with the incidents, groups are not made again
    assert not any(x in lines for x in ("ObjectHashAggregate", "min_by", "regexp_extract"))
    members = {}
    for r in sorted(grouped.collect(), key=lambda r: r.seq):
        members.setdefault((r.group_key, r.bucket), []).append(r)
    assert max(map(len, members.values())) > 5
    keys = {r.incident_id: (r.group_key, r.bucket) for r in incidents.collect()}
    got = evidence.collect()
    assert len(got) == len(members) and {keys[r.incident_id] for r in got} == set(members)
    for r in got:
        rows = members[keys[r.incident_id]]
        assert [e.message for e in r.extra.sample_events] == [e.message for e in rows[:5]]
        assert r.ip == next((e.src_ip for e in rows if e.src_ip), None) and r.user == next((e.user for e in rows if e.user), None)
        ids = [f"{r.incident_id}:event-{i + 1}" if e.session_hint is None else e.session_hint for i, e in enumerate(rows[:5])]
        assert [x.session_id for x in r.sessions] == ids and [x.start_time for x in r.sessions] == [e.timestamp for e in rows[:5]]
        assert [x.auth_failed for x in r.sessions] == [int((e.event_action or "").lower() == "login_failed") for e in rows[:5]]
    # incidents without the names, events without the group: the same rows
    plain = ev.generic_evidence(incidents.drop("ip", "user"), _normalized(spark))
    assert sorted(map(repr, plain.collect())) == sorted(map(repr, got))


def test_payloads_are_written_before_they_are_read(spark):
    lines = plan(ENTRIES["generic_payload_values"].run(spark, SF)).splitlines()
    reading = [line for line in lines if "from_json(" in line]
    assert len(reading) == 1 and "StructsToJson" not in reading[0] and "to_json" not in reading[0]
    assert any("Generate explode" in line for line in lines)
