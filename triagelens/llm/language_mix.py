"""Language identification as inference of a mixture.

Every language has a distribution over hashed character trigrams, learned from
labelled documents. A document is a mixture: expectation-maximisation estimates the
proportion of each language from its trigrams' likelihoods. The set of languages is
chosen by penalised likelihood: starting from the best single language, the language
with the largest proportion in the full mixture is added as long as the likelihood
grows by more than the penalty.

Defined results: a text that is null or has no letter is ``und`` with score 0, as is
every text if nothing can be learned; of more than ``LANGUAGES`` different labels the most
frequent ones are learned (ties by code point); an id of null is never held out; repeated rows
are each predicted; an empty table gives an empty result. Only id and text are read
for a prediction.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triagelens.llm.common import crc32_mod, documents, small_batches

BUCKETS = 1 << 15
LABELLED = 20_000  # labelled rows of a language to learn from, about; chosen by hash
SMOOTHING = 0.5
ROUNDS = 12
PENALTY = 0.02  # log likelihood per trigram that a further language must add
UNDETERMINED = "und"
SLAB = 1 << 20  # characters of a text that are counted at once
LANGUAGES = 500  # distinct labels to learn, the most frequent ones; bounds the model


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """For every code point, whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def trigram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the trigrams of ``text`` and how often each occurs.

    Letters are lower-cased, everything between words is one space. Empty if there is
    no letter.
    """
    total = None
    for begin in range(0, max(len(text), 1), SLAB):
        part = text[max(0, begin - 2) : begin + SLAB].lower()
        points = np.frombuffer(f" {part} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        is_letter = letters()[points]
        if not is_letter.any():
            continue
        points = np.where(is_letter, points, 32).astype(np.uint64)
        points = points[np.concatenate(([True], (points[1:] != 32) | (points[:-1] != 32)))]
        mixed = points[:-2] * np.uint64(0x9E3779B97F4A7C15) + points[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + points[2:] * np.uint64(0x165667B19E3779F9)
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        bucket = (mixed >> np.uint64(64 - 15)).astype(np.int64)
        if len(bucket) < BUCKETS // 8 and len(text) <= SLAB:
            return np.unique(bucket, return_counts=True)
        counted = np.bincount(bucket, minlength=BUCKETS)
        total = counted if total is None else total + counted
    if total is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    found = np.flatnonzero(total)
    return found, total[found]


# --------------------------------------------------------------------------- learning


def learn(docs: DataFrame, learn_from: Column, lang_col: str = "lang", rows: int = LABELLED) -> tuple[list[str], np.ndarray]:
    """Languages and their log probabilities, one row of BUCKETS for each."""
    spark = docs.sparkSession
    small_batches(spark)
    labelled = documents(docs, F.col(lang_col).alias("lang")).where(F.col("lang").isNotNull() & learn_from)
    # One row per language; each is learned from up to about ``rows`` of its own, so that a
    # rare one is not lost among the others.
    sizes = dict(map(tuple, labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()))
    learned = F.broadcast(spark.createDataFrame([(lang,) for lang in sizes], "lang string"))
    labelled = labelled.join(learned, "lang", "left_semi")
    common = [(lang, int((1 << 30) * rows / n)) for lang, n in sizes.items() if n > rows]
    if common:
        below = F.broadcast(spark.createDataFrame(common, "lang string, _below long"))
        place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30))
        labelled = labelled.join(below, "lang", "left").where(F.col("_below").isNull() | (place < F.col("_below")))
    tasks = 12 * max(1, -(-sum(min(n, rows) for n in sizes.values()) // LABELLED))

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                found, times = trigram_counts(text)
                sums.setdefault(lang, np.zeros(BUCKETS, np.int64))[found] += times
        for lang, counted in sums.items():
            found = np.flatnonzero(counted)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(found)), pa.array(found, pa.int32()), pa.array(counted[found], pa.int64())],
                names=["lang", "bucket", "n"],
            )

    # The sample is bounded, so a few tasks are enough and few partial counts move.
    counts = labelled.select("text", "lang").repartition(tasks).mapInArrow(count, "lang string, bucket int, n long")
    counts = counts.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    names = sorted(counts["lang"].unique())
    table = np.full((len(names), BUCKETS), SMOOTHING)
    table[counts["lang"].map({name: i for i, name in enumerate(names)}).to_numpy(int), counts["bucket"].to_numpy()] += counts["n"].to_numpy()
    return names, np.log(table / table.sum(axis=1, keepdims=True))


# -------------------------------------------------------------------------- inference


def mixture(likelihood: np.ndarray, times: np.ndarray, start: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Proportions of the languages (rows) by expectation-maximisation."""
    share = start
    total = times.sum()
    for _ in range(rounds):
        weight = times / (share @ likelihood)
        new = share * (likelihood @ weight) / total
        done = np.abs(new - share).max() < 1e-3
        share = new
        if done:
            break
    return share / share.sum()


def infer(logs: np.ndarray, found: np.ndarray, times: np.ndarray, penalty: float = PENALTY) -> tuple[np.ndarray, list[int], np.ndarray]:
    """Full mixture, chosen languages by proportion, and their proportions."""
    here = logs[:, found]
    top = here.max(axis=0)
    likelihood = np.exp(here - top)
    count = len(here)
    total = times.sum()
    full = mixture(likelihood, times, np.full(count, 1 / count))
    single = here @ times
    chosen = [int(np.argmax(single))]
    share = np.ones(1)
    reached = float(single[chosen[0]] - top @ times)
    needed = penalty * total + 0.5 * np.log(total + 1)
    for other in np.argsort(-full, kind="stable"):
        if int(other) in chosen:
            continue
        tried = [*chosen, int(other)]
        if full[other] < 1e-3:
            break
        begin = np.maximum(full[tried], 1e-6)
        new = mixture(likelihood[tried], times, begin / begin.sum())
        value = float(np.log(new @ likelihood[tried]) @ times)
        if value - reached <= needed:
            break
        chosen, share, reached = tried, new, value
    order = sorted(range(len(chosen)), key=lambda i: (-share[i], chosen[i]))
    return full, [chosen[i] for i in order], share[order]


def predict(docs: DataFrame, names: list[str], logs: np.ndarray, penalty: float = PENALTY) -> DataFrame:
    """``doc_id, lang_pred, score, langs`` of every row.

    ``score`` is the predicted language's proportion in the full mixture; ``langs``
    lists the chosen languages with their proportions.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("langs", pa.string())])
    model = logs.astype(np.float32)

    def run(batches):
        table = model.astype(np.float64)

        def one(text):
            found, times = trigram_counts(text)
            if not len(found) or not names:
                return UNDETERMINED, 0.0, ""
            full, chosen, share = infer(table, found, times.astype(np.float64), penalty)
            listed = ",".join(f"{names[i]}:{p:.2f}" for i, p in zip(chosen, share, strict=True))
            return names[chosen[0]], float(min(max(full[chosen[0]], 0.0), 1.0)), listed

        for batch in batches:
            out = [one(text) for text in batch.column("text").to_pylist()]
            columns = [batch.column("doc_id")] + [pa.array([r[i] for r in out], schema.types[i + 1]) for i in range(3)]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    small_batches(docs.sparkSession)
    return documents(docs).mapInArrow(run, "doc_id long, lang_pred string, score double, langs string")


def held_out() -> Column:
    return F.coalesce(crc32_mod(F.col("doc_id"), 5) == 0, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, langs``; held-out labels are not learned from."""
    names, logs = learn(docs, ~held_out())
    return predict(docs, names, logs).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "langs")
