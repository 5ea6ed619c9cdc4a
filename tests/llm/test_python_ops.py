"""Top-k, token counts, toxicity, archives and languages against plain Python."""


import gzip
import hashlib
import random

import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models, pre_tokenizers

from triagelens.llm import language_mix, token_counts, topk, toxicity, warc

SF = "/root/testdata/sf0.01"
UNIGRAM = public_tokenizers.path("piece_bpe_32k.model")


def table(spark, name, sf=SF):
    return spark.read.parquet(f"{sf}/{name}.parquet")


# ------------------------------------------------------------------------------- top-k


def brute_top(rows, k, every):
    vectors = {}
    for vec_id, v in rows:
        if vec_id is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            vectors[vec_id] = [int(np.floor(64 * float(x))) for x in v]
    width = max((len(v) for v in vectors.values()), default=0)
    ids = sorted(vectors)
    table_ = np.array([vectors[i] + [0] * (width - len(vectors[i])) for i in ids], dtype=np.int64)
    out = []
    for q, row in zip(ids, table_, strict=True):
        if q % every == 0:
            scores = table_ @ row
            best = sorted((-int(s), i) for s, i in zip(scores, ids, strict=True) if i != q)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


def test_top_k_real(spark):
    vectors = table(spark, "embeddings")
    got = topk.top_k(vectors, F.col("vec_id") % 20 == 0, block=100, group=8)
    assert sorted(map(tuple, got.collect())) == brute_top([(r.vec_id, r.embedding) for r in vectors.collect()], 20, 20)


def test_top_k_odd_rows(spark):
    rng = random.Random(4)
    rows = [(i, [rng.choice([-1.5, -0.3, 0.0, 0.01, 0.26, 3.0]) for _ in range(5)]) for i in range(150)]
    rows += [(200, None), (201, [1.0, None, 0.0, 0.0, 0.0]), (202, [float("nan")] * 5), (203, [float("inf")] + [0.0] * 4), (None, [1.0] * 5)]
    rows += [(220, []), (240, [2.0, 1.0]), (260, [0.0] * 5), rows[40], rows[41], (280, rows[3][1]), (281, rows[3][1])]
    vectors = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, rank int, block int")
    for block, group in ((1000, 1000), (17, 3)):
        got = topk.top_k(vectors, F.col("vec_id") % 20 == 0, block=block, group=group)
        assert sorted(map(tuple, got.collect())) == brute_top(rows, 20, 20)
    few = topk.top_k(vectors.limit(3), F.col("vec_id") >= 0)
    assert few.count() == 6
    assert topk.top_k(vectors.limit(0), F.col("vec_id") >= 0).collect() == []


# ------------------------------------------------------------------------ token counts


@pytest.fixture(scope="module")
def unigram():
    pieces, has_bytes = token_counts.pieces_of(UNIGRAM)
    assert has_bytes
    vocabulary = [("<unk>", 0.0)] + [(f"<0x{b:02X}>", 0.0) for b in range(256)] + pieces

    def count(text):
        # The library takes its lowest score over all entries; only ordinary ones count here.
        tokenizer = count.tokenizer
        return len(tokenizer.encode(text, add_special_tokens=False).ids) if text else 0

    count.tokenizer = Tokenizer(models.Unigram(vocabulary, unk_id=0, byte_fallback=True))
    count.tokenizer.pre_tokenizer = pre_tokenizers.Metaspace(prepend_scheme="always", split=True)
    return count


def test_token_counts(spark, unigram):
    rng = random.Random(8)
    alphabet = list("abcdeinrst ") + ["é", "ß", "漢", "\U0001f600", "\n", "  ", "▁", "\x00", "the", "ing"]
    texts = [None, "", " ", "▁", "a", "  a  ", "漢字" * 30, "\U0001f600 \U0001f601x", "word " * 50]
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 60))) for _ in range(300)]
    texts += [r.text for r in table(spark, "documents", "/root/testdata/sf0.001").collect()]
    docs = spark.createDataFrame([(i, t, 3, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int, lang string")
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs, UNIGRAM).collect()}
    assert got == {i: unigram(t) for i, t in enumerate(texts)}
    assert token_counts.count_tokens(docs.limit(0), UNIGRAM).collect() == []


def test_ties_and_unknown_characters():
    count = token_counts.Counter([("ab", -1.0), ("c", -1.0), ("a", -1.0), ("bc", -1.0), ("b", -5.0)], byte_pieces=False)
    assert count.part("abc") == 2
    assert count.part("xyz") == 1 and count.part("axya") == 3
    assert token_counts.Counter([("a", -1.0)], byte_pieces=True).part("é") == 2


# ---------------------------------------------------------------------------- toxicity


def test_toxicity_held_out(spark):
    docs, labels = table(spark, "documents", "/root/testdata/sf0.1"), table(spark, "labels", "/root/testdata/sf0.1")
    rows = toxicity.classify(docs, labels).collect()
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == int(r.score >= 0.3) for r in rows)
    tested = [(truth[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in truth]
    counts = Counter(tested)
    assert counts[1, 1] >= 0.9 * (counts[1, 1] + counts[1, 0])
    assert counts[0, 1] <= 0.03 * (counts[0, 0] + counts[0, 1])


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automaton_against_edit_distance():
    rng = random.Random(2)
    terms = ["abba", "babab", "cabbage", "abcabcabc", "bacabacabaca"]
    matcher = toxicity.Matcher([(t, False) for t in terms])
    words = ["".join(rng.choice("abcd") for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    for term in terms:
        for _ in range(200):
            letters = list(term)
            for _ in range(rng.randint(0, 3)):
                at = rng.randrange(len(letters) + 1)
                letters[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "d"])
            words.append("".join(letters))
    for word in words:
        near = min((edit_distance(word, t), i) for i, t in enumerate(terms))
        allowed = [(edit_distance(word, t), i) for i, t in enumerate(terms) if edit_distance(word, t) <= toxicity.edits_allowed(t)]
        want = (min(allowed)[0], [min(allowed)[1]]) if allowed else None
        assert matcher.look_up(word) == want, (word, near)


def test_stems_and_context():
    matcher = toxicity.Matcher([("idiot", False), ("lowei", True), ("worthless", False)])
    assert matcher.look_up("loweichen") == (0, [1]) and matcher.look_up("lowi") is None

    def kinds(text):
        return [k for k, _ in toxicity.hits_of(text, matcher)[1]]

    assert kinds("you idiot") == [0]
    assert kinds('the word "idiot" is old') == [2]
    assert kinds("she said idiot") == [2]
    assert kinds("idoit " + "x " * 20 + "idiott") == [3]
    assert kinds("wortless idiot") == [1, 0]
    assert kinds("") == []


def test_toxicity_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 0.5), (1, "", 0.5), (None, "idiot", 0.1), (4, "x" * 300000, None), (4, "x" * 300000, None)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, None, 1), (1, 1, 0), (None, None, None), (4, 1, None)], "doc_id long, quality int, toxic int")
    rows = toxicity.classify(docs, labels).collect()
    assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows)
    assert len(toxicity.classify(docs, labels.limit(0)).collect()) == 5
    assert toxicity.classify(docs.limit(0), labels).collect() == []


# ----------------------------------------------------------------------------- archives


def brute_warc(rows):
    payloads = [(r[0], (r[1] or "").encode()) for r in rows]
    largest = {}
    for page_id, p in payloads:
        if page_id is not None and len(p) >= 1000:
            largest[p] = max(largest.get(p, page_id), page_id)
    out = Counter()
    for page_id, p in payloads:
        revisit = p in largest and page_id != largest[p]
        out[(page_id, len(p), hashlib.sha1(p).hexdigest(), "revisit" if revisit else "response", largest[p] if revisit else None)] += 1
    return out


def test_warc_real(spark):
    pages = table(spark, "pages")
    rows = pages.collect()
    got = Counter(map(tuple, warc.round_trip(spark, pages.withColumn("payload", F.lit(1))).collect()))
    assert got == brute_warc([(r.page_id, r.html) for r in rows])


def odd_pages():
    big = "é\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n" * 60
    rows = [(1, None, None), (2, "http://a/ b\r\nX: y", ""), (3, "u", "\r\n\r\n"), (4, "u", big), (5, "v", big), (6, None, big), (6, None, big), (None, "n", big)]
    rows += [(7, "u", "s" * 999), (8, "u", "s" * 999), (9, "u", "t" * 1000), (10, "u", "t" * 1000), (11, "http://é/ü?q=1&b", "\r\n" * 700), (None, "u", "z" * 2000), (None, "u", "z" * 2000)]
    return rows


def test_warc_odd_rows(spark, tmp_path):
    pages = spark.createDataFrame([(*r, "x") for r in odd_pages()], "page_id long, url string, html string, record_type string")
    want = brute_warc([(r[0], r[2]) for r in odd_pages()])
    assert Counter(map(tuple, warc.round_trip(spark, pages).collect())) == want
    assert warc.round_trip(spark, pages.limit(0)).collect() == []
    archive = warc.write_archives(warc.heads(pages.repartition(3)), str(tmp_path / "one"))
    records = warc.read_archives(spark, str(tmp_path / "one"), archive)
    assert {(r.page_id, r.url) for r in records.collect()} == {(r[0], r[1]) for r in odd_pages()}
    # Leave out a response: deduplication finds a new one among what can be read.
    again = warc.deduplicate(spark, str(tmp_path / "one"), archive, str(tmp_path / "two"))
    assert again != archive
    assert Counter(map(tuple, warc.resolve(warc.read_archives(spark, str(tmp_path / "two"), again)).collect())) == want


def test_warc_format(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/b", "héllo"), (2, "http://a/c", "x" * 1500), (3, "http://a/d", "x" * 1500)], "page_id long, url string, html string")
    warc.write_archives(warc.heads(pages.coalesce(1)), str(tmp_path / "w"))
    content = b"".join(gzip.decompress(p.read_bytes()) for p in sorted((tmp_path / "w").glob("part-*.gz")))
    seen = []
    while content:
        head, content = content.split(b"\r\n\r\n", 1)
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        assert head.startswith(b"WARC/1.1\r\n")
        length = int(fields["Content-Length"])
        block, content = content[:length], content[length:]
        assert content[:4] == b"\r\n\r\n"
        content = content[4:]
        seen.append((fields["WARC-Type"], fields["WARC-Target-URI"], block.split(b"\r\n\r\n", 1)[1]))
    assert sorted(seen) == sorted([("response", "http://a/b", "héllo".encode()), ("revisit", "http://a/c", b""), ("response", "http://a/d", b"x" * 1500)])


def test_warc_many_revisits(spark):
    """Record starts are found wherever the line reader refills its buffer."""
    n = 500_000
    html = F.when(F.col("id") % 10 == 0, F.concat(F.col("id").cast("string"), F.lit("\r\n\r\n"))).otherwise(F.lit("x" * 1000))
    pages = spark.range(0, n, 1, 4).select(F.col("id").alias("page_id"), F.lit("http://a/b").alias("url"), html.alias("html"))
    got = warc.round_trip(spark, pages).groupBy("record_type", "refers_to").agg(F.count("*").alias("n"), F.countDistinct("page_id").alias("ids"))
    own = n // 10
    want = {("response", None, own + 1, own + 1), ("revisit", n - 1, n - own - 1, n - own - 1)}
    assert set(map(tuple, got.collect())) == want


# ---------------------------------------------------------------------------- languages


def test_languages_held_out(spark):
    docs = table(spark, "documents")
    truth = {r.doc_id: r.lang for r in docs.collect()}
    rows = language_mix.identify(docs.withColumn("langs", F.lit("x"))).collect()
    assert len(rows) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    tested = [r.lang_pred == truth[r.doc_id] for r in rows if r.held_out]
    assert sum(tested) >= 0.97 * len(tested)


def test_mixtures(spark):
    docs = table(spark, "documents")
    long = {}
    for r in docs.where("n_chars between 2000 and 8000").orderBy("doc_id").collect():
        long.setdefault(r.lang, r.text)
    texts = [long["en"][:1800] + "\n" + long["de"][:1800], long["fr"][:1500], long["es"][:2500] + long["en"][:500], "12 34", "", None, "\U0001f600"]
    names, logs = language_mix.learn(docs, ~language_mix.held_out())
    mixed = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, [x.split(":")[0] for x in r.langs.split(",") if x]) for r in language_mix.predict(mixed, names, logs).collect()}
    assert set(got[0][1]) == {"en", "de"} and got[1] == ("fr", ["fr"]) and got[2][0] == "es" and set(got[2][1]) == {"es", "en"}
    assert all(got[i] == ("und", []) for i in (3, 4, 5, 6))


def test_rare_language_is_learned(spark):
    docs = [(i, "the cat and the dog went home", "en") for i in range(2000)] + [(5000, "żółć gęślą jaźń", "pl")]
    docs = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    for first in range(8):
        shifted = docs.withColumn("doc_id", F.col("doc_id") + first * 10_000)
        assert language_mix.learn(shifted, F.lit(True), rows=100)[0] == ["en", "pl"]


def test_language_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "en"), (None, "abc", None), (2, "x" * 300000, None), (2, "x" * 300000, None), (3, "", "de")], "doc_id long, text string, lang string")
    assert len(language_mix.identify(docs).collect()) == 5
    assert {r.lang_pred for r in language_mix.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert language_mix.identify(docs.limit(0)).collect() == []


def test_em_recovers_proportions():
    rng = np.random.default_rng(1)
    models_ = rng.dirichlet(np.full(200, 0.3), 3)
    share = np.array([0.6, 0.3, 0.1])
    times = rng.multinomial(200_000, share @ models_).astype(float)
    got = language_mix.mixture(models_, times, np.full(3, 1 / 3), rounds=200)
    assert np.abs(got - share).max() < 0.02


def test_more_labels_than_are_learned(spark, monkeypatch):
    """The most frequent labels are learned, no table is refused."""
    monkeypatch.setattr(language_mix, "LANGUAGES", 2)
    texts = {"aa": "lorem ipsum dolor sit amet ", "bb": "quick brown fox jumps over ", "cc": "xyzzy plugh zork grue "}
    rows = [(i, texts[lang] * 5, lang) for lang, ids in (("aa", range(1, 40)), ("bb", range(41, 80)), ("cc", range(81, 90))) for i in ids]
    out = language_mix.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert len(out) == len(rows) and {r.lang_pred for r in out} == {"aa", "bb"}
    assert all(r.lang_pred == "aa" for r in out if r.doc_id < 40) and all(r.lang_pred == "bb" for r in out if 40 < r.doc_id < 80)


def test_every_labelled_row_is_learned_from(spark):
    """Rows that share a passage are all trusted, though candidates are counted once in them."""
    rows = [(i, "the same passage stands in all of these texts " * 3 + f"and number {i}") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 4 == 0) for i in range(40)], "doc_id long, toxic boolean").withColumn("toxic", F.col("toxic").cast("int"))
    sample = toxicity.training_rows(docs, labels, F.lit(True))
    assert sample.where("toxic = 1").count() == 10 and sample.count() == 40
    kept = toxicity.without_shared_passages(sample)
    assert {r.toxic for r in kept.collect()} == {0, 1}
