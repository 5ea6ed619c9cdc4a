"""Byte-level BPE by chunks against the library on whole texts."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest

from triagelens.llm import bpe

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


def texts():
    rng = random.Random(3)
    alphabet = ["a", "B", "é", " ", "  ", "\n", "\n\n", "1", "23", "'s", "'re", "!?", "\t", "\U0001f600", "漢字", "　", "word", " x"]
    out = [None, "", " ", "a", "x" * 900, "1" * 700 + "a", " " * 800 + "a", "\n" * 500, "it's" * 300, "end   "]
    out += ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 900))) for _ in range(150)]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "clash", i) for i, t in enumerate(texts())]
    rows += [rows[-1], rows[-1], (None, "null id " * 40, None, 0), (7, "same id, other text " * 30, "", 1), (7, "same id, other text " * 30, "", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, part int")


def want(rows):
    encoder = bpe.encoding(VOCABULARY, PATTERN)
    out = Counter()
    for r in rows:
        ids = encoder.encode_ordinary(r.text or "")
        out[(r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())] += 1
    return out


@pytest.mark.parametrize("chunk, overlap", [(1 << 16, 512), (64, 16), (7, 3), (40, 0)])
def test_digests(docs, chunk, overlap):
    got = bpe.digests(docs, VOCABULARY, PATTERN, chunk, overlap)
    assert Counter(map(tuple, got.collect())) == want(docs.collect())


# Letters and numbers of one Unicode version that are unassigned in another.
NEWER = [chr(c) for c in (0x558, 0x58B, 0x88F, 0x208F, 0x11DE0, 0x11DE1, 0x17F, 0x212A)]


def test_engines_agree_on_classes():
    split, encoder, rng = bpe.splitter(PATTERN), bpe.encoding(VOCABULARY, PATTERN), random.Random(9)
    alphabet = [*NEWER, "a", "B", "1", " ", "\n", "!", "?", "'s", "'re", "'ll", "  ", "é"]
    for _ in range(2000):
        text = "".join(rng.choice(alphabet) for _ in range(40))
        ids = [i for piece in split.finditer(text) for i in encoder.encode_ordinary(piece[0])]
        assert ids == encoder.encode_ordinary(text)


def test_long_texts_with_newer_characters(spark):
    """Beyond a chunk of the default length the ids are still those of the library."""
    rng = random.Random(5)
    rows = [(i, ("word " + c + "'s next ") * 8000) for i, c in enumerate(NEWER)]
    rows += [(20 + i, "".join(rng.choice([*NEWER, "'s", "'re", " 7", "!", "ab", "  "]) for _ in range(90_000))) for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = bpe.digests(docs, VOCABULARY, PATTERN)
    assert Counter(map(tuple, got.collect())) == want(docs.collect())


def test_real_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = bpe.digests(docs, VOCABULARY, PATTERN, 500, 60)
    assert Counter(map(tuple, got.collect())) == want(docs.collect())


def test_parts_and_decoding(docs):
    parts = bpe.decode(bpe.encode(docs, VOCABULARY, PATTERN, 64, 16), VOCABULARY, PATTERN).collect()
    texts_of = {}
    for r in sorted(parts, key=lambda r: r.part):
        texts_of.setdefault((r.doc_id, r.text_key), {}).setdefault(r.part, bytes(r.content))
    whole = {(k[0], b"".join(v.values())) for k, v in texts_of.items()}
    assert whole == {(r.doc_id, (r.text or "").encode()) for r in docs.collect()}


def test_empty_table(spark):
    assert bpe.digests(spark.createDataFrame([], "doc_id long, text string"), VOCABULARY, PATTERN).collect() == []
