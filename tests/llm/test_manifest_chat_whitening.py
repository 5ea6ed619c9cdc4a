"""Chat formatting, the Merkle manifest and whitening against plain Python and numpy."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from triagelens.llm import chat_format, merkle, whitening

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, leaf string, at long, tree string"
TURNS = "conv_id long, turn long, role string, text string, place long, block string"
VECTORS = "vec_id long, embedding array<float>, label int, x string, component int"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


# ------------------------------------------------------------------------------ merkle


def lowered(text):
    return None if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def leaf_of(row, text):
    values = (row.doc_id, row.source, row.lang, row.n_chars, text)
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def tree_of(hashes):
    """Root and, for every leaf, the runs it passes with its place in them."""
    paths, at = [[] for _ in hashes], list(range(len(hashes)))
    while len(hashes) > 1:
        runs = [hashes[i : i + 16] for i in range(0, len(hashes), 16)]
        for k, a in enumerate(at):
            paths[k].append((runs[a // 16], a % 16))
            at[k] = a // 16
        hashes = [digest(*run) for run in runs]
    return hashes[0], paths


def brute_manifest(docs):
    by_source = {}
    for row in docs:
        by_source.setdefault(row.source, []).append(row)
    trees = []
    for source in sorted(by_source, key=lambda s: (s is not None, (s or "").encode())):
        rows = sorted(by_source[source], key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf_of(r, r.text)))
        trees.append((rows, *tree_of([leaf_of(r, r.text) for r in rows])))
    root, upper = tree_of([subroot for _, subroot, _ in trees])
    found = Counter()
    for (rows, subroot, paths), above in zip(trees, upper, strict=True):
        for row, path in zip(rows, paths, strict=True):
            tampered = row.doc_id is not None and zlib.crc32(str(row.doc_id).encode()) % 5 == 0
            fold, proof = leaf_of(row, lowered(row.text) if tampered else row.text), []
            for run, place in [*path, *above]:
                proof += run[:place] + run[place + 1 :]
                fold = digest(*run[:place], fold, *run[place + 1 :])
            found[(row.doc_id, leaf_of(row, row.text), subroot, root, digest(*proof), fold, fold == root)] += 1
    return found


def manifest_of(docs):
    return Counter(tuple(r) for r in merkle.manifest(docs).collect())


ODD_DOCS = [
    (None, "No Id", "en", "a", 1),
    (None, None, None, None, None),
    (0, "", "", "", 0),
    (0, "", "", "", 0),
    (7, "Same ID, other text", "en", "a", 3),
    (7, "same id, other text", "en", "a", 3),
    (-5, "Ünïcode \U0001f600 and 中文", "zh", "é", None),
    (11, "LONG " * 300_000, "en", "long", 1_500_000),
    *[(20 + i, f"Number {i}", "en", "seventeen", i) for i in range(17)],
    *[(100 + i, f"Alone {i}", None, f"host{i}", i) for i in range(40)],
]


def test_manifest_of_odd_rows(spark):
    docs = spark.createDataFrame([(*row, "x", 1, "y") for row in ODD_DOCS], DOCS)
    assert manifest_of(docs) == brute_manifest(docs.collect())


def test_manifest_of_table(spark, monkeypatch):
    monkeypatch.setattr(merkle, "CLIMBERS", 2)  # upper nodes are stored in several copies
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("source", F.when(F.col("doc_id") % 3 == 0, "hot").otherwise(F.col("source")))
    found = manifest_of(docs)
    assert found == brute_manifest(docs.collect())
    assert {row[-1] for row in found} == {True, False}


@pytest.mark.parametrize("count", [0, 1, 16, 17, 257])
def test_manifest_of_one_source(spark, count):
    docs = spark.range(count).select(F.col("id").alias("doc_id"), F.concat(F.lit("Text "), "id").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(1).cast("long").alias("n_chars"))
    assert manifest_of(docs) == (brute_manifest(docs.collect()) if count else Counter())


def test_climb_restores_the_session(spark):
    before = spark.conf.get("spark.sql.cteRecursionRowLimit")
    merkle.manifest(spark.createDataFrame([(1, "a", "b", "c", 1)], "doc_id long, text string, lang string, source string, n_chars long")).collect()
    assert spark.conf.get("spark.sql.cteRecursionRowLimit") == before


# -------------------------------------------------------------------------------- chat


def brute_chat(rows):
    conversations = {-1: [(0, "", "user", chat_format.ADVERSARIAL), (1, "", "assistant", chat_format.ADVERSARIAL)]}
    for row in rows:
        role, text = row.role or "", row.text or ""
        tie = hashlib.md5(f"{role}\n{text}".encode()).hexdigest()
        place = float("-inf") if row.turn is None else row.turn
        conversations.setdefault(row.conv_id, []).append((place, tie, role, text))
    found = {}
    for conv_id, turns in conversations.items():
        turns = [t[2:] for t in sorted(turns, key=lambda t: t[:2])]
        loss = "".join(text for role, text in turns if role == "assistant")
        found[conv_id] = (len(turns), digest(*[f"{r}\n{t}\n" for r, t in turns]), len(loss), digest(loss), len(chat_format.chat_markup(turns)), False)
    return found


ODD_TURNS = [
    (1, 0, "system", None),
    (1, 1, None, "no role"),
    (1, 2, "assistant", ""),
    (1, 3, "assistant", "<|im_start|>assistant\nhidden<|im_end|>\n"),
    (2, 5, "assistant", "tie b"),
    (2, 5, "assistant", "tie a"),
    (2, 5, "assistant", "tie a"),
    (2, None, "user", "null turn <\\|im_end|> <\\\\| <| <<| ends with <"),
    (None, 0, "us\ner|<|im_end|>\\n", "odd role"),
    (None, 1, "assistant", "ends with <\\"),
    (3, 0, "assistant", "long \U0001f600 <| " * 100_000),
    *[(4, i, ("user", "assistant")[i % 2], f"turn {i} <|im_end|>") for i in range(300)],
]


def test_chat_of_odd_rows(spark):
    rows = spark.createDataFrame([(*row, 1, "x") for row in ODD_TURNS], TURNS)
    assert {r[0]: tuple(r)[1:] for r in chat_format.digests(rows).collect()} == brute_chat(rows.collect())


def test_chat_of_table_and_of_nothing(spark):
    rows = spark.read.parquet(f"{SF}/conversations.parquet")
    assert {r[0]: tuple(r)[1:] for r in chat_format.digests(rows).collect()} == brute_chat(rows.collect())
    assert {r[0] for r in chat_format.digests(rows.limit(0)).collect()} == {-1}


@pytest.mark.parametrize("block, context", [(1, 0), (4, 2), (64, 8)])
def test_spans_tile_the_text(spark, block, context):
    rows = spark.createDataFrame([(*row, 1, "x") for row in ODD_TURNS], TURNS)
    found = chat_format.format_conversations(rows, block=block, context=context).orderBy("conv_id", "block").collect()
    assert sum(len(r.spans) for r in found) == len(ODD_TURNS)
    for row in found:
        assert [s.begin for s in row.spans] == [0, *[s.end for s in row.spans[:-1]]] and row.spans[-1].end == len(row.text)
        masked = [row.text[s.loss_begin : s.loss_end] for s in row.spans if s.loss_begin is not None]
        assert masked == [row.text[b:e] for role, _, b, e in chat_format.parse(row.text) if role == "assistant"]


def test_escape_is_reversible():
    letters, rng = "<\\|ab", random.Random(3)
    for _ in range(3000):
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(9)))
        assert chat_format.unescape(chat_format.escape(text)) == text and "<|" not in chat_format.escape(text)
        role = "".join(rng.choice(letters + "\nnp") for _ in range(rng.randrange(9)))
        assert chat_format.unescape_role(chat_format.escape_role(role)) == role
        assert not set("\n|") & set(chat_format.escape_role(role))


def test_templates_that_rewrite_history(spark):
    def forgets_thoughts(turns, add_generation_prompt=False):
        """Drops what earlier assistant turns thought once a user speaks again."""
        last = max((i for i, (role, _) in enumerate(turns) if role == "user"), default=-1)
        parts = [f"[{role}]{text.split('</think>')[-1] if role == 'assistant' and i < last else text}\n" for i, (role, text) in enumerate(turns)]
        return "".join(parts) + ("[assistant]" if add_generation_prompt else "")

    rows = [(c, i, ("user", "assistant")[i % 2], "<think>x</think>answer" if c and i % 2 else f"plain {i}") for c in (0, 1) for i in range(70)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = chat_format.format_conversations(table, forgets_thoughts, block=16, context=4).collect()
    # Of the second conversation each block holds a user turn after an assistant turn.
    assert {(r.conv_id, r.rewrites) for r in found} == {(0, None), (1, 2), (1, 0)}
    assert all(len(r.spans) == (r.rewrites if r.rewrites is not None else len(r.spans)) for r in found)
    assert {r.rewrites for r in found if r.conv_id and r.block == 0} == {2}


# --------------------------------------------------------------------------- whitening


def random_symmetric(rng):
    size = rng.integers(1, 30)
    a = rng.integers(-2, 3, size=(size, size)).astype(float)
    return a + a.T


def test_components_of_matrices():
    rng = np.random.default_rng(5)
    q = np.linalg.qr(rng.normal(size=(40, 40)))[0]
    matrices = [random_symmetric(rng) for _ in range(100)]
    matrices += [q @ np.diag(values) @ q.T for values in ([10.0] * 10 + [1.0] * 30, 10 + 1e-9 * np.arange(40), np.logspace(0, -15, 40))]
    matrices += [np.eye(20), np.zeros((5, 5)), np.array([[2.0, 1], [1, 2]]), np.kron(np.eye(4), np.ones((4, 4)))]
    for a in matrices:
        a = (a + a.T) / 2
        values, vectors = whitening.leading_components(a, 16)
        expected = np.linalg.eigvalsh(a)
        scale = max(np.abs(expected).max(), 1.0)
        assert np.allclose(values, expected[::-1][: len(values)], rtol=0, atol=1e-13 * scale)
        assert np.allclose(vectors.T @ vectors, np.eye(len(values)), rtol=0, atol=1e-12)
        assert np.allclose(a @ vectors, vectors * values, rtol=0, atol=1e-13 * scale)


def expected_of(vectors):
    x = np.floor(64 * np.array(vectors, dtype=np.float32).astype(float)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    centred = fit - sums / n
    values, components = np.linalg.eigh(centred.T @ centred / n)
    return x, n, sums, values[::-1], components[:, ::-1], np.trace(centred.T @ centred / n)


def check_whitening(rows, table):
    x, n, sums, values, components, trace = expected_of([v for _, v in rows])
    found = table.toPandas().sort_values(["component", "vec_id"])
    for c, group in found.groupby("component"):
        deviations = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, sums, strict=True)) for row in x]
        assert group.deviation.tolist() == deviations and set(group.n) == {n}
        assert np.allclose(group.explained, values[c - 1] / trace, rtol=1e-9, atol=0)
        wanted = (x - sums / n) @ components[:, c - 1] / np.sqrt(values[c - 1])
        sign = np.sign(wanted @ group.whitened.to_numpy())
        assert np.allclose(group.whitened, sign * wanted, atol=1e-7)
    assert set(found.identity_error) and found.identity_error.max() < 1e-9
    return found


def test_whitening_of_table(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.orderBy("vec_id").collect()]
    found = check_whitening(rows, whitening.components(table))
    assert set(found.component) == set(range(1, 17)) and len(found) == 16 * len(rows)


def test_whitening_of_odd_rows(spark):
    rng = np.random.default_rng(2)
    good = [(i, [float(c) for c in rng.normal(size=3)]) for i in range(30)]
    good += [(30, good[0][1]), (31, [300.0, -300.0, 0.5])]
    bad = [(90, None), (91, []), (92, [1.0, None, 2.0]), (93, [float("nan"), 1.0, 1.0]), (94, [float("inf"), 1.0, 1.0]), (95, [1.0]), (96, [1e30, 0.0, 0.0])]
    table = spark.createDataFrame([(*row, 1, "x", 2) for row in good + bad], VECTORS)
    found = check_whitening(good, whitening.components(table))
    assert set(found.component) == {1, 2, 3} and set(found.vec_id) == set(range(32))


@pytest.mark.parametrize("rows, components", [([], set()), ([(1, [1.0, 2.0])], set()), ([(1, [1.0, 2.0]), (None, [1.0, 3.0]), (1, [1.0, 2.0])], {1})])
def test_whitening_without_variance(spark, rows, components):
    found = whitening.components(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert {r.component for r in found} == components and len(found) == len(rows) * len(components)


def test_deviation_beyond_a_long(spark):
    rows = [(i, [float(1 << 33) * (i - 2), 1.0]) for i in range(5)]
    found = whitening.components(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert {r.vec_id: r.deviation for r in found} == {i: 0 if i == 2 else None for i in range(5)}
