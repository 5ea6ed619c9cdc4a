"""The pipeline against a plain version of each stage over that stage's own input."""

import importlib
import re
import shutil
from collections import Counter

import pytest

from .test_bpe import PATTERN, VOCABULARY
from .test_jaccard_join import brute
from .test_native_ops import brute_targets
from triagelens.llm import bpe, toxicity

corpus_pipeline = importlib.import_module("corpus_pipeline")
SF = "/root/testdata/sf0.01"
COLUMNS = list(corpus_pipeline.COLUMNS)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """sf0.001 with some odd rows added."""
    where = tmp_path_factory.mktemp("tables")
    shutil.copy(f"{SF}/labels.parquet", where / "labels.parquet")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = [(9000, None, None, None, None), (9001, "", "en", "src0", 0), (9001, "", "en", "src0", 0), (None, "one two three four five six", "en", None, 27),
           (9002, "secret: abcdefgh1 " + "word " * 60, "en", "src1", 10), (9003, "idiot " * 30 + "you worthless moron", "en", "src1", 10), (9004, "solo", "en", "src2", 4), (9004, "other solo", "en", "src2", 4)]
    docs.unionByName(spark.createDataFrame(odd, docs.schema)).write.parquet(str(where / "documents.parquet"))
    return str(where)


def rows(df):
    return Counter(tuple(r[c] for c in COLUMNS) for r in df.collect())


def test_every_stage(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    steps = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, steps[-1], folder).write.parquet(str(tmp_path / str(i)))
        steps.append(spark.read.parquet(str(tmp_path / str(i))))
    assert all(step.columns == COLUMNS for step in steps[:-1])
    before, tame, single, clean, mixed = map(rows, steps[:5])

    model = toxicity.learn(docs, spark.read.parquet(f"{folder}/labels.parquet"), ~toxicity.held_out())
    score = model.scorer()
    assert tame == Counter({r: n for r, n in before.items() if score(r[1] or "") < 0.3})
    assert not any(r[0] == 9003 for r in tame) and len(tame) < len(before)

    listed = list(tame.elements())
    root = Counter((d, c) for d, n, c in brute([(r[0], r[1]) for r in listed]) if n)
    kept_ids = {c for _, c in root}
    with_words = [r for r in single.elements() if (r[1] or "").split()]
    assert {r[0] for r in with_words} == kept_ids
    assert sum(1 for r in single.elements() if not (r[1] or "").split()) == sum(1 for r in listed if not (r[1] or "").split())
    assert set(single) <= set(tame)

    assert sum(clean.values()) == sum(single.values())
    secret = re.compile(r"AKIA[A-Z0-9]{16}|[0-9a-f]{24}|password=\w{6}")
    assert any(secret.search(r[1] or "") for r in single) and not any(secret.search(r[1] or "") for r in clean)
    assert Counter(r for r in clean.elements() if "[secret]" not in (r[1] or "")) == Counter(
        r for r in single.elements() if r in clean
    )

    size = Counter()
    for r in clean.elements():
        size[r[3]] += len((r[1] or "").split())
    taken = Counter()
    for r, n in mixed.items():
        assert r in clean and n <= 3 * clean[r]
        taken[r[3]] += n * len(r[1].split())
    longest = {s: max(len((r[1] or "").split()) for r in clean if r[3] == s) for s in size}
    assert all(abs(taken[s] - t) <= longest[s] for s, t in brute_targets(size).items())

    encoder = bpe.encoding(VOCABULARY, PATTERN)
    want = Counter((r[0], tuple(encoder.encode_ordinary(r[1] or ""))) for r in mixed.elements())
    parts = steps[5].collect()
    assert all(r.part == 0 and r.n_tokens == len(r.ids) for r in parts)
    assert Counter((r.doc_id, tuple(r.ids)) for r in parts) == want

    whole = corpus_pipeline.run(spark, folder)
    assert Counter((r.doc_id, tuple(r.ids)) for r in whole.collect()) == want


def test_empty_documents(spark, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
