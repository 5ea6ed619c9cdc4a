"""Jaccard join against all pairs, and its lower bounds."""

import random

import numpy as np
import pytest

from triagelens.llm import jaccard_join as jj


def shingles(text, width=5):
    words = (text or "").encode().lower().split()
    width = min(width, len(words))
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if words else set()


def brute(rows):
    sets = [shingles(text) for _, text in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    where = {}
    for i, s in enumerate(sets):
        for x in s:
            where.setdefault(x, []).append(i)
    for i, s in enumerate(sets):
        for j in {j for x in s for j in where[x] if j < i}:
            if 100 * len(s & sets[j]) >= 80 * len(s | sets[j]):
                parent[root(i)] = root(j)
    first = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            first[root(i)] = min(first.get(root(i), doc_id), doc_id)
    return sorted(((d, len(sets[i]), first.get(root(i), d)) for i, (d, _) in enumerate(rows)), key=str)


def generated():
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(400)] + ["Über", "été", "\x1c", "a b"]
    rows = [(0, None), (1, ""), (2, " \n\t"), (3, "one"), (4, "ONE"), (5, "a b c"), (6, "a b c d e"), (7, "A  b\tc d\x0be"), (None, "a b c"), (None, "null id only here now")]
    shared = [rng.choice(vocabulary) for _ in range(30)]
    for length in (8, 9, 12, 20, 45, 46, 90, 300, 900):
        for _ in range(3):
            base = [rng.choice(vocabulary) for _ in range(length)]
            for change in range(9):
                words = list(base)
                for _ in range(change * max(1, length // 60)):
                    words[rng.randrange(len(words))] = rng.choice(vocabulary)
                if change % 3 == 2:
                    words += shared[: length // 8]
                rows.append((len(rows), rng.choice([" ", "  ", "\n"]).join(words)))
    rows += [(len(rows) + i, " ".join(shared[: 6 + i % 20])) for i in range(60)]
    return rows + [rows[30], rows[31], (rows[40][0], "another text for an id that is there")]


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rows = generated()
    random.Random(seed).shuffle(rows)
    docs = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, n int, set_id string").repartition(7)
    got = jj.components(docs).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_real_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = jj.components(docs).collect()
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert sorted(map(tuple, got), key=str) == want
    assert len({r[2] for r in want}) < len(want)


def test_sketches_bound_the_difference():
    rng = np.random.default_rng(5)
    bands = jj.Bands()
    met = 0
    for _ in range(1500):
        n = int(rng.integers(4, 400))
        pool = np.unique(rng.integers(0, 1 << 63, 3 * n + 10).astype(np.uint64))
        rng.shuffle(pool)
        a = np.sort(pool[:n])
        drop, add = int(rng.integers(0, n // 8 + 1)), int(rng.integers(0, n // 8 + 1))
        b = np.sort(np.concatenate([a[rng.permutation(n)[drop:]], pool[n : n + add]]))
        assert jj.differing_bits(jj.bit_sketch(a), jj.bit_sketch(b)) <= drop + add
        if 100 * (n - drop) >= 80 * (n + add):
            met += 1
            assert drop + add <= bands.allowed(len(a) + len(b))
            assert set(jj.join_keys(a, bands).tolist()) & set(jj.join_keys(b, bands).tolist())
    assert met > 500


def test_split_buckets(spark, monkeypatch):
    """Cells of few sets give the same components."""
    monkeypatch.setattr(jj, "CELL", 3)
    monkeypatch.setattr(jj, "CELL_MEMBERS", 200)
    rows = generated()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, jj.components(docs).collect()), key=str) == brute(rows)


def test_sets_leave_cells_not_pairs(spark):
    """Near copies of one text, many pairs of them just below the similarity: what leaves the
    comparison grows with the sets, and so do the links found."""
    rng = random.Random(4)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(400):
        words = list(base)
        for _ in range(rng.randrange(1, 5)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**9)}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    sketched = jj.sketch(docs).cache()
    sets = sketched.groupBy("set_id").agg(*[jj.F.first(c).alias(c) for c in ("n", "small", "bits")], jj.F.min("doc_id").alias("place")).cache()
    met = jj.buckets(sketched).cache()
    labels = spark.createDataFrame([], "node long, label long")
    found = jj.open_sets(met, labels, sets).cache()
    links = jj.open_links(found, docs, sets).collect()
    assert found.where("set_id is not null").count() <= 400 and found.where("set_id is null").count() < 400 * 16
    count = len({r[2] for r in brute(rows)})
    assert 400 - count <= len(links) <= 400 * 3
    assert sorted(map(tuple, jj.components(docs).collect()), key=str) == brute(rows)


def test_empty_table(spark):
    assert jj.components(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_long_chain_of_links(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501)], "a long, b long")
    labels = {r.node: r.label for r in jj.connected(links).collect()}
    assert set(labels.values()) == {0, 500} and len(labels) == 203
