"""Host-level quality rules.

Every document is checked against rules on its own text. The share of failing
documents of a host is then shrunk towards all hosts: a beta prior is fitted to the
hosts' failure rates by the method of moments, and a host's rate is the posterior
mean, so a host with two documents says little and a host with many says much. A
document is kept if it passes its own base rules and its host is not rejected.

Counting repeated 3-word windows needs no shuffle: the windows' hashes are sorted
together with their positions inside the row, equal neighbours are repeated windows,
and the words they cover are summed over the sorted positions.

Defined results: a null text has no words; documents without a host (null) have no
host verdict and depend on their own rules; repeated rows are documents of their own;
an empty table gives an empty result. Further columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triagelens.llm.common import BLANK_CLASS, BLANKS, documents, written

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEATED = 50  # percent of words
MAX_HOST_RATE = 0.5  # a host above this posterior failure rate is rejected


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, f"{BLANK_CLASS}+"), lambda w: w != "")


def repeated_words(words: Column) -> Column:
    """Number of words inside 3-word windows that occur twice or more."""
    windows = F.transform(
        F.sequence(F.lit(0), F.size(words) - 3),
        lambda i: F.struct(
            F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("p")
        ),
    )
    ordered = F.sort_array(windows)
    return F.when(F.size(words) < 3, F.lit(0)).otherwise(_covered(ordered))


def _covered(ordered: Column) -> Column:
    """Words covered by the windows that have an equal neighbour in ``ordered``."""

    def in_row(windows: Column) -> Column:
        twins = F.filter(
            windows,
            lambda w, i: (F.get(windows, i - 1)["h"] == w["h"]) | (F.get(windows, i + 1)["h"] == w["h"]),
        )
        places = F.sort_array(F.transform(twins, lambda w: w["p"]))
        return F.aggregate(
            places,
            F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
            lambda acc, p: F.struct((acc["n"] + F.least(F.lit(3), p - acc["last"])).alias("n"), p.alias("last")),
            lambda acc: acc["n"],
        )

    # One lambda variable holds the sorted array, so that it is made once per row.
    return F.get(F.transform(F.array(ordered), in_row), F.lit(0))


def measure(docs: DataFrame, *keep: str | Column) -> DataFrame:
    """Base figures and the base verdict of every row; no shuffle, no Python."""
    base = documents(docs, *keep)
    kept = base.columns[2:]
    bare = F.translate(F.col("text"), BLANKS, "")
    lines = F.filter(F.split("text", "\n", -1), lambda line: F.length(F.translate(line, BLANKS, "")) > 0)

    def figures(words: Column) -> Column:
        return F.struct(F.size(words).cast("long").alias("n_words"), repeated_words(words).cast("long").alias("n_repeat_words"))

    counted = F.get(F.transform(F.array(words_of(F.col("text"))), figures), F.lit(0))
    dup_lines = F.get(F.transform(F.array(lines), lambda x: F.size(x) - F.size(F.array_distinct(x))), F.lit(0))
    out = base.select(
        "doc_id",
        *kept,
        counted.alias("_counted"),
        F.length(bare).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate(F.col("text"), SYMBOLS, ""))).cast("long").alias("n_symbols"),
        dup_lines.cast("long").alias("n_dup_lines"),
    )
    out = out.select("doc_id", *kept, "_counted.n_words", "word_chars", "n_symbols", "n_dup_lines", "_counted.n_repeat_words")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def host_verdicts(measured: DataFrame, host_col: str = "host", max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """One row per host: documents, failures, shrunk failure rate, verdict.

    With ``m`` and ``v`` the mean and variance of the hosts' raw rates, the prior is
    beta(a, b) with a + b = m (1 - m) / v - 1, at least ``1e-6``. Without spread
    between hosts (one host, or all rates equal) the prior has the weight of one
    average host.
    """
    hosts = (
        measured.where(F.col(host_col).isNotNull())
        .groupBy(F.col(host_col).alias("host"))
        .agg(F.count("*").alias("n_docs"), F.count(F.when(F.col("base_failed"), 1)).alias("n_failed"))
    )
    rate = F.col("n_failed") / F.col("n_docs")
    prior = hosts.agg(F.avg(rate).alias("m"), F.var_pop(rate).alias("v"), F.avg("n_docs").alias("size"))
    strength = F.when(F.col("v") > 1e-12, F.greatest(F.col("m") * (1 - F.col("m")) / F.col("v") - 1, F.lit(1e-6)))
    prior = prior.select("m", F.coalesce(strength, F.col("size")).alias("strength"))
    shrunk = (F.col("n_failed") + F.col("m") * F.col("strength")) / (F.col("n_docs") + F.col("strength"))
    mean, weight = prior.first()  # one row, whatever the input
    shrunk = (F.col("n_failed") + F.lit(mean) * F.lit(weight)) / (F.col("n_docs") + F.lit(weight))
    return hosts.select(
        "host",
        "n_docs",
        "n_failed",
        F.round(shrunk, 6).alias("host_rate"),
        (shrunk > max_rate).alias("host_rejected"),
    )


def apply_host_rules(docs: DataFrame, host_col: str = "source", max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """Figures, base verdict, host rate and ``kept`` of every row."""
    measured = written(measure(docs, F.col(host_col).alias("host")), "host-rules")
    verdicts = host_verdicts(measured, "host", max_rate).select("host", "host_rate", "host_rejected")
    joined = measured.join(verdicts, "host", "left")
    kept = ~F.col("base_failed") & ~F.coalesce(F.col("host_rejected"), F.lit(False))
    return joined.select(*measured.columns, "host_rate", kept.alias("kept"))
