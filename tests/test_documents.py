import json
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

from triagelens.models import detectors
from triagelens.operators.features import NUMERIC_FEATURES
from triagelens.plans.documents import document_lines, json_text, opened, read_documents, write_documents
from triagelens.session import scratch_path, stage


def whole(path):
    """The documents in the files, put one after another."""
    text = "".join(f.read_text() for f in sorted(Path(path).glob("part-*")))
    found, at, read = [], 0, json.JSONDecoder()
    while text[at:].strip():
        at += len(text[at:]) - len(text[at:].lstrip())
        value, at = read.raw_decode(text, at)
        found.append(value)
    return found


def test_a_long_list_lies_in_several_files(spark):
    n = 200_000
    rows = spark.range(n + 300).select(
        F.when(F.col("id") < n, "hot").otherwise(F.concat(F.lit("d"), F.col("id") % 10)).alias("doc"), F.col("id").alias("place")
    )
    entries = rows.withColumn("entry", F.to_json(F.struct(F.col("place").alias("at"))))
    heads = rows.select("doc").distinct().withColumn("opening", opened(F.struct("doc")))
    path = scratch_path(spark, "documents")
    write_documents(document_lines(heads, {"events": entries.repartition(7, "entry")}, "doc"), path, "doc", files=8)
    back = whole(path)
    assert [d["doc"] for d in back] == sorted(d["doc"] for d in back) and len(back) == 11
    for d in back:
        want = range(n) if d["doc"] == "hot" else [i for i in range(n, n + 300) if f"d{i % 10}" == d["doc"]]
        assert [e["at"] for e in d["events"]] == list(want)
    holding = [f for f in Path(path).glob("part-*") if sum(len(line) for line in f.open()) > 0]
    sizes = [sum(1 for _ in f.open()) for f in holding]
    assert len(holding) >= 6 and max(sizes) < 0.3 * n  # the hot document is spread
    read = read_documents(spark, path)
    assert read.count() == n + 300
    assert read.where(F.get_json_object("entry", "$.at").cast("long") - F.col("position") != 0).where(F.col("opening") == '{"doc":"hot",').count() == 0


def test_odd_documents(spark):
    """No entries, several lists, line breaks, quotes, frames inside texts, entries without a head."""
    texts = ['{"a":[', "]", "two\nlines", '"', "", " x", "],\"b\":["]
    heads = spark.createDataFrame([("a", None), ("b", 'q"'), ("c", "z")], "doc string, note string")
    heads = heads.select("doc", opened(F.struct("doc", "note")).alias("opening"))
    first = spark.createDataFrame([("b", i, t) for i, t in enumerate(texts)] + [("x", 1, "lost")], "doc string, place int, t string")
    second = spark.createDataFrame([("a", 2, "n"), ("a", 1, None), ("c", 9, "last")], "doc string, place int, t string")
    lists = {k: df.select("doc", "place", json_text(F.col("t")).alias("entry")) for k, df in {"first": first, "second": second}.items()}
    path = scratch_path(spark, "documents")
    write_documents(document_lines(heads, lists, "doc"), path, "doc", files=3)
    assert whole(path) == [
        {"doc": "a", "note": None, "first": [], "second": [None, "n"]},
        {"doc": "b", "note": 'q"', "first": texts, "second": []},
        {"doc": "c", "note": "z", "first": [], "second": ["last"]},
    ]
    rows = read_documents(spark, path).orderBy("document", "list", "position").collect()
    assert [(r.document, r.list, r.position, r.entry and json.loads(r.entry)) for r in rows] == [
        (1, "first", None, None), (1, "second", 0, None), (1, "second", 1, "n"),
        *[(2, "first", i, t) for i, t in enumerate(texts)], (2, "second", None, None),
        (3, "first", None, None), (3, "second", 0, "last"),
    ]


def test_no_documents(spark):
    heads = spark.createDataFrame([], "doc string, opening string")
    entries = spark.createDataFrame([("a", 1, "1")], "doc string, place int, entry string")
    path = scratch_path(spark, "documents")
    write_documents(document_lines(heads, {"l": entries}, "doc"), path, "doc")
    assert whole(path) == [] and read_documents(spark, path).count() == 0


def test_every_tree_has_its_own_whole_sample(spark):
    """The forest is the same for any partitioning, and each tree is grown from ``sample_size`` rows."""
    n, rng = 3000, np.random.default_rng(2)
    values = rng.normal(size=(n, len(NUMERIC_FEATURES)))
    rows = [("a", "u", "", i, *[float(x) for x in v]) for i, v in enumerate(values)]
    schema = "k_ip string, k_user string, k_agent string, session_no long, " + ", ".join(f"{f} double" for f in NUMERIC_FEATURES)
    df = stage(spark.createDataFrame(rows, schema), "points")
    one = detectors._fit_iforest(df, detectors.fit_scaler(df), trees=20)
    two = detectors._fit_iforest(df.repartition(5, "session_no"), detectors.fit_scaler(df), trees=20)
    assert one[1] == two[1] == {"sample_size": 256, "trees": 20}
    assert all(np.array_equal(one[0][k], two[0][k]) for k in one[0])
    tree, feature, threshold = (one[0][k] for k in ("tree", "feature", "threshold"))
    assert sorted(set(tree)) == list(range(20))
    # different samples: the first splits of all trees differ
    assert len({(int(f), float(t)) for f, t in zip(feature[np.searchsorted(tree, range(20))], threshold[np.searchsorted(tree, range(20))])}) == 20
    small = detectors._fit_iforest(df.limit(40), detectors.fit_scaler(df), trees=3)
    assert small[1]["sample_size"] == 40


def test_document_lines_are_not_ranked(spark, tmp_path, monkeypatch):
    """entries are carried to their documents once and written as lines once, and read back once."""
    from triagelens.operators import ranking
    from triagelens.plans import documents

    written = []
    for module in (documents, ranking):
        monkeypatch.setattr(module, "stage", lambda df, name: written.append(name) or stage(df, name))
    heads = spark.createDataFrame([("a", '{"doc":"a",'), ("b", '{"doc":"b",')], "doc string, opening string")
    entries = spark.createDataFrame([("a", 2, "2"), ("a", 1, "1"), ("c", 1, "9")], "doc string, place long, entry string")
    path = str(tmp_path / "d")
    write_documents(document_lines(heads, {"l": entries, "m": entries.where("place = 2")}, "doc"), path, "doc", files=2)
    rows = read_documents(spark, path).orderBy("document", "list", "position").collect()
    assert [(r.document, r.list, r.position, r.entry) for r in rows] == [(1, "l", 0, "1"), (1, "l", 1, "2"), (1, "m", 0, "2"), (2, "l", None, None), (2, "m", None, None)]
    assert [r.opening for r in rows] == ['{"doc":"a","l":['] * 3 + ['{"doc":"b","l":['] * 2
    assert written == ["document-lines", "lines"]


def test_structured_payload_fields_makes_events_once(spark, monkeypatch):
    """events and incidents are written once, not made again for every branch."""
    from triagelens import catalog

    written = []
    monkeypatch.setattr(catalog, "stage", lambda df, name: written.append(name) or stage(df, name))
    df = catalog.ENTRIES["structured_payload_fields"].run(spark, "/root/testdata/sf0.001")
    assert written == ["normalized", "generic"]
    assert df.where("events <> total_event_count").count() == 0 and df.agg(F.sum("events")).first()[0] > 0
