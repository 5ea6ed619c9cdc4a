import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from helpers import event, events
from triagelens.operators.features import NUMERIC_FEATURES
from triagelens.models import detectors, jobs, kernels
from triagelens.models.vectors import vector
from triagelens.operators import features as feat
from triagelens.plans.sinks import write_json
from triagelens.session import scratch_path, stage
from triagelens.streaming import jobs as streams


@pytest.fixture(scope="module")
def features(spark):
    rng = random.Random(1)
    rows, seq = [], 0
    for s in range(120):
        wild = s % 30 == 7
        for i in range(60 if wild else rng.randrange(1, 4)):
            seq += 1
            status = 401 if wild else rng.choice([200, 404, None])
            rows.append(event(seq, s * 4000 + i * (1 if wild else 300), f"10.0.0.{s % 40}", f"u{s}", status))
    return stage(feat.session_features(events(spark, rows)), "features")


def test_average_path():
    assert [round(float(x), 4) for x in kernels.average_path([1, 2, 256])] == [0.0, 1.0, 10.2448]


def test_tree_isolates_points():
    rng = np.random.default_rng(0)
    rows = kernels.grow_tree(np.array([[0.0], [0.1], [10.0]]), rng)
    leaves = [r for r in rows if r[1] == -1]
    assert len(rows) == 2 * len(leaves) - 1 and {r[0] for r in rows} == set(range(len(rows)))


def test_nearest_and_outlier_factor_against_brute_force():
    rng = np.random.default_rng(3)
    points = rng.normal(size=(80, 4))
    distance, index = kernels.nearest(points, points, 5, skip_self=0)
    full = np.sqrt(((points[:, None] - points[None]) ** 2).sum(-1))
    np.fill_diagonal(full, np.inf)
    assert np.allclose(distance, np.sort(full, axis=1)[:, :5], atol=1e-6)
    assert all(i not in row for i, row in enumerate(index))
    density = kernels.reach_density(distance, index, distance[:, -1])
    far = kernels.outlier_factor(np.array([[9.0] * 4]), points, 5, distance[:, -1], density)
    assert far[0] > 3


@pytest.mark.parametrize("kind", detectors.KINDS)
def test_models_flag_the_wild_sessions(spark, features, kind):
    model = jobs.train(features, kind, "ssh_auth")
    rows = jobs.score_sessions(features, model).select("session_id", "event_count", "anomaly_score").collect()
    above = [r for r in rows if r.anomaly_score > 0]
    assert 1 <= len(above) <= 0.15 * len(rows)
    if kind == "iforest":  # to the others the wild sessions, being alike, are a small cluster
        ranked = sorted(rows, key=lambda r: -r.anomaly_score)
        assert sum(r.event_count == 60 for r in ranked[:6]) >= 3
    path = scratch_path(spark, "model")
    detectors.save(spark, model, path)
    again = detectors.load(spark, path)
    assert again.metadata["session_count"] == 120 and again.kind == kind
    for a, b in zip(rows, jobs.score_sessions(features, again).select("session_id", "event_count", "anomaly_score").collect()):
        assert a.session_id == b.session_id and abs(a.anomaly_score - b.anomaly_score) < 1e-9


def test_lof_uses_every_session(spark):
    """More rows than the former sample of 20,000, with copies, against all distances."""
    n = 20_500
    names = detectors.NUMERIC_FEATURES
    rng = np.random.default_rng(4)
    points = np.concatenate([rng.normal(size=(n - 40, len(names))) * (1 + np.arange(n - 40) % 5)[:, None], np.ones((40, len(names)))])
    df = stage(spark.createDataFrame(pd.DataFrame(points, columns=names).assign(id=range(n), k_ip="a", k_user="u", k_agent="", session_no=range(n))), "points")
    model = detectors.fit(df, "lof")
    got = np.array([r.raw + model.params["offset"] for r in detectors.score(df, model, "raw").select("id", "raw").orderBy("id").collect()])
    x = (points - np.array(model.scaler.mean)) / np.array(model.scaler.scale)

    def nearest(skip):
        parts = [kernels.nearest(x[s : s + 500], x, 20, s if skip else None) for s in range(0, n, 500)]
        index = np.concatenate([p[1] for p in parts])
        return np.sqrt(((x[:, None] - x[index]) ** 2).sum(-1)), index

    distance, index = nearest(True)
    k_distance = distance.max(axis=1)
    density = kernels.reach_density(distance, index, k_distance)
    assert abs(model.params["offset"] / np.percentile(density[index].mean(axis=1) / density, 95) - 1) < 1e-6
    distance, index = nearest(False)
    assert np.allclose(got, density[index].mean(axis=1) / kernels.reach_density(distance, index, k_distance), rtol=1e-6)


def test_iforest_does_not_depend_on_partitions(features):
    a = detectors.fit(features.repartition(3), "iforest", trees=20)
    b = detectors.fit(features.repartition(7, "user"), "iforest", trees=20)
    assert all(np.array_equal(a.arrays[n], b.arrays[n]) for n in a.arrays) and a.params == b.params


def test_ocsvm_follows_the_exact_kernel_solution(features):
    model = detectors.fit(features, "ocsvm")
    rows = features.select(vector(model.scaler).alias("v")).collect()
    points = np.array([r.v for r in rows])
    square = ((points[:, None] - points[None]) ** 2).sum(-1)
    kernel = np.exp(-model.params["gamma"] * square)
    n, cap = len(points), 1 / (0.05 * len(points))
    alpha = np.full(n, 1 / n)
    for t in range(4000):  # conditional gradient on the exact dual
        best, left = np.zeros(n), 1.0
        for i in np.argsort(kernel @ alpha, kind="stable"):
            best[i] = min(cap, left)
            left -= best[i]
            if left <= 0:
                break
        alpha += 2 / (t + 2) * (best - alpha)
    exact = kernel @ alpha
    ours = kernels.fourier_map(points, model.arrays["weights"], model.arrays["phase"]) @ model.arrays["normal"]
    rank = lambda x: np.argsort(np.argsort(x))
    assert np.corrcoef(rank(exact), rank(ours))[0, 1] > 0.7


def test_mean_of_the_lowest_share_in_one_pass(spark, features):
    """Bins against sorting all projections."""
    scaler = detectors.fit_scaler(features)
    rows = stage(features.select(vector(scaler).alias("v")).repartition(5), "vectors")
    points = np.array([r.v for r in rows.collect()])
    rng = np.random.default_rng(9)
    weights, phase = rng.normal(0, 0.2, (points.shape[1], 64)), rng.uniform(0, 6, 64)
    mapped = kernels.fourier_map(points, weights, phase)
    normal = detectors._lowest_mean(rows, weights, phase, np.zeros(64), 1.0)
    assert np.allclose(normal, mapped.mean(axis=0))
    low = detectors._lowest_mean(rows, weights, phase, normal, 0.25)
    order = np.argsort(mapped @ normal)[: len(points) // 4]
    exact = mapped[order].mean(axis=0)
    width = 2 * np.sqrt(2 * (normal @ normal)) / detectors.BINS
    assert abs(float((low - exact) @ normal)) <= width


def test_unknown_model_and_empty_training(spark, features):
    with pytest.raises(ValueError):
        detectors.fit(features, "forest")
    with pytest.raises(ValueError, match="No training data"):
        detectors.fit(features.limit(0), "iforest")


def test_ensemble(spark, features):
    models = {k: detectors.fit(features, k) for k in ("iforest", "lof")}
    out = jobs.score_sessions_multi(features, models).cache()
    row = out.agg(F.min("ensemble_score").alias("a"), F.max("iforest_score_norm").alias("b")).first()
    assert row.a >= 0 and row.b == 1.0
    assert out.where("anomaly_score <> iforest_score").count() == 0


def test_compare(features):
    rows = jobs.compare_models(features, 95.0).collect()
    assert {r.model_type for r in rows} == set(detectors.KINDS)
    assert all(r.score_min <= r.score_mean <= r.score_max and 0.04 <= r.fraction_above_threshold <= 0.08 for r in rows)


def test_stream_sessions_with_late_rows(spark, tmp_path):
    frame = lambda rows: events(spark, rows)
    schema = frame([event(1, 0)]).schema
    src = str(tmp_path / "in")
    frame([event(1, 0, "a", "u", 401), event(2, 1800, "a", "u", 200), event(3, 20000, "b", "u", 200)]).coalesce(1).write.parquet(src)
    stream = spark.readStream.schema(schema).parquet(src)
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    first = streams.run_to_table(streams.stream_sessions(stream), out, state)
    assert [(r.ip, r.event_count, r.auth_fail_ratio) for r in first.collect()] == [("a", 2, 0.5)]
    # a late row of the closed session is dropped; a newer event closes b
    frame([event(4, 10, "a", "u", 401), event(5, 40000, "c", "u", 200)]).coalesce(1).write.mode("append").parquet(src)
    second = streams.run_to_table(streams.stream_sessions(stream), out, state)
    assert sorted((r.ip, r.event_count) for r in second.collect()) == [("a", 2), ("b", 1)]
    with pytest.raises(ValueError):
        streams.stream_generic_incidents(stream, 45)


def test_stream_lines(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.log").write_text("Dec 10 06:55:48 LabSZ sshd[1]: Failed password for root from 1.2.3.4 port 1 ssh2\njunk\n")
    from triagelens.sources.events import parse_ssh

    stream = parse_ssh(streams.stream_lines(spark, str(src))).select("ts", "ip", "status")
    rows = streams.run_to_table(stream, str(tmp_path / "out"), str(tmp_path / "state")).collect()
    assert [(r.ip, r.status) for r in rows] == [("1.2.3.4", 401)]


def test_json_sink_keeps_nulls(spark, tmp_path):
    df = spark.createDataFrame([("a", None, float("nan"))], "s string, u string, x double")
    write_json(df, str(tmp_path / "o"))
    assert spark.read.text(str(tmp_path / "o")).first()[0] == '{"s":"a","u":null,"x":null}'


def test_ring_index_compares_few_and_misses_none(spark):
    """The 20 nearest of 5,000 rows in clusters, against all distances."""
    rng, n, names = np.random.default_rng(8), 5000, detectors.NUMERIC_FEATURES
    centres = rng.normal(size=(25, len(names))) * 20
    points = centres[rng.integers(0, 25, n)] + rng.normal(size=(n, len(names)))
    rows = [(i, [float(c) for c in p], 1) for i, p in enumerate(points)]
    table = stage(spark.createDataFrame(rows, "point long, v array<double>, copies long"), "points")
    compared = spark.sparkContext.accumulator(0)
    index = detectors._index(table, points[:25])
    found = detectors._neighbours(table, table, index, 20, own=True, compared=compared).toPandas().sort_values(["point", "distance"])
    exact = np.concatenate([kernels.nearest(points[s : s + 500], points, 20, s)[1] for s in range(0, n, 500)])
    want = np.sort(np.sqrt(((points[:, None] - points[exact]) ** 2).sum(-1)), axis=1)
    assert np.allclose(found.distance.to_numpy().reshape(n, 20), want, rtol=1e-9)
    assert compared.value < n * n / 2


NORMALIZED_ROW = (
    "seq long, event_ts timestamp, severity string, event_action string, session_hint string, src_ip string, "
    "user string, host string, service string"
)


def test_stream_incidents_to_the_end_with_exact_names(spark, tmp_path):
    """20,000 names of one hot group, more than an approximate count gets right, in two files; the last bucket is closed by the end."""
    from datetime import datetime, timedelta

    start = datetime(2024, 1, 1, 10, 0)
    rows = [(i, start + timedelta(milliseconds=30 * i), "error" if i % 2 else "warn", None, "h", f"10.0.{i % 50}.1", f"u{i}", " ", None) for i in range(20_000)]
    rows += [(20_000, start + timedelta(hours=3), None, "login_failed", None, None, None, "web", None)]
    src = str(tmp_path / "in")
    spark.createDataFrame(rows[:9_000], NORMALIZED_ROW).coalesce(1).write.parquet(src)
    spark.createDataFrame(rows[9_000:], NORMALIZED_ROW).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(NORMALIZED_ROW).option("maxFilesPerTrigger", 1).parquet(src)
    make = lambda events: streams.stream_generic_incidents(events, late="30 minutes")
    done = streams.run_to_end(make, stream, "event_ts", str(tmp_path / "out"), str(tmp_path / "state"))
    got = {r.group_key: (r.event_count, r.error_count, r.warning_count, r.distinct_users, r.distinct_hosts, r.distinct_src_ips) for r in done.collect()}
    assert got == {"session_hint:h": (20_000, 10_000, 10_000, 20_000, 0, 50), "host:web": (1, 0, 0, 0, 1, 0)}
    # ending it once more adds nothing
    again = streams.run_to_end(make, stream, "event_ts", str(tmp_path / "out"), str(tmp_path / "state"))
    assert again.count() == 2


def test_reference_is_sent_to_groups_of_blocks(spark, monkeypatch):
    """F1 to F5: many blocks of points meet the reference as few groups, and no neighbour is lost."""
    rng = np.random.default_rng(5)
    n, k = 2000, 5
    x = rng.normal(size=(n, len(NUMERIC_FEATURES)))
    table = spark.createDataFrame([(i, row.tolist(), 1) for i, row in enumerate(x)], "point long, v array<double>, copies long")
    monkeypatch.setattr(detectors, "BLOCK", 20)
    kept = {}
    monkeypatch.setattr(detectors, "stage", lambda df, name: kept.setdefault(name, stage(df, name)) if name == "needed" else stage(df, name))
    index = detectors._index(table, x[:8])
    found = detectors._neighbours(table, table, index, k, own=True).toPandas().sort_values(["point", "distance"])
    assert kept["needed"].select("own").distinct().count() <= 2 * spark.sparkContext.defaultParallelism
    square = ((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2)
    np.fill_diagonal(square, np.inf)
    assert np.allclose(found["distance"].to_numpy().reshape(n, k), np.sqrt(np.sort(square, axis=1)[:, :k]))
    ids, copies, vectors = kernels.unpack(kernels.pack(np.arange(3), np.ones(3), x[:3]), 3)
    assert (ids == np.arange(3)).all() and (copies == 1).all() and (vectors == x[:3]).all()


def _table(spark, points, copies=None):
    rows = [(i, [float(c) for c in p], int(c)) for i, (p, c) in enumerate(zip(points, copies if copies is not None else np.ones(len(points))))]
    return stage(spark.createDataFrame(rows, "point long, v array<double>, copies long"), "points")


def test_leaves_compare_a_small_part_of_all_pairs(spark):
    """F1 to F5: 8,000 rows of 64 kinds on a surface of three dimensions, with copies, against all distances."""
    rng, n, k = np.random.default_rng(11), 8000, 20
    kinds = rng.integers(0, 2, size=(n, 6)).astype(float)
    points = np.concatenate([rng.normal(size=(n, 3)) @ rng.normal(size=(3, len(NUMERIC_FEATURES) - 6)), 3 * kinds], axis=1)
    points[:5] += 100  # far from all others
    copies = np.where(np.arange(n) % 500 == 0, 30, 1)
    table = _table(spark, points, copies)
    compared = spark.sparkContext.accumulator(0)
    found = detectors._neighbours(table, table, detectors._index(table, points[::1000]), k, own=True, compared=compared)
    got = {p: g.sort_values("distance") for p, g in found.toPandas().groupby("point")}
    assert compared.value < 0.65 * n * n
    for i in [*range(10), *range(500, n, 411)]:
        away = np.repeat(np.sqrt(((points - points[i]) ** 2).sum(axis=1)), copies - (np.arange(n) == i))
        assert np.allclose(np.repeat(got[i].distance, got[i].times), np.sort(away)[:k], rtol=1e-9) and got[i].times.sum() == k


def test_neighbours_of_rows_in_cells_with_few_others(spark):
    """F1 to F5: 40 cells of 100 rows, so a row's own cell holds fewer than its neighbours."""
    rng, k = np.random.default_rng(12), 20
    points, asked = rng.normal(size=(100, len(NUMERIC_FEATURES))), 3 * rng.normal(size=(30, len(NUMERIC_FEATURES)))
    index = kernels.grow_cells(points, 40)
    assert len(np.unique(kernels.cell_of(points, index))) == 40
    table = _table(spark, points)
    square = lambda x: np.sqrt(((x[:, None] - points[None]) ** 2).sum(axis=-1))
    for rows, own in ((asked, False), (points, True)):
        found = detectors._neighbours(_table(spark, rows) if not own else table, table, index, k, own=own).toPandas().sort_values(["point", "distance"])
        want = np.sort(square(rows), axis=1)[:, int(own) : k + int(own)]
        assert np.allclose(found.distance.to_numpy().reshape(len(rows), k), want)
        assert np.allclose(found.k_distance.to_numpy().reshape(len(rows), k), want[:, -1:]) and found["last"].sum() == len(rows)


def test_training_rows_keep_their_factor(spark, monkeypatch):
    """F1 to F5: rows the model was trained on are not compared again, with the scores that comparing gives."""
    rng, n, names = np.random.default_rng(13), 900, NUMERIC_FEATURES
    points = rng.normal(size=(n, len(names))).round(1)
    points[100:140] = points[100]  # more copies than neighbours
    points[200:203] = points[200]
    df = stage(spark.createDataFrame(pd.DataFrame(points, columns=names).assign(id=range(n))), "points")
    model = detectors.fit(df, "lof")
    calls, real = [], detectors._neighbours
    monkeypatch.setattr(detectors, "_neighbours", lambda *a, **o: calls.append(1) or real(*a, **o))
    scores = lambda rows, m: np.array([r.raw for r in detectors.score(rows, m, "raw").orderBy("id").select("raw").collect()])
    kept = scores(df, model)
    assert not calls and len(kept) == n
    model.table = model.table.withColumn("factor", F.lit(None).cast("double"))
    assert np.allclose(kept, scores(df, model), rtol=1e-9) and len(calls) == 1
