"""A training-data pipeline over ``documents``, stage by stage.

Toxic documents are rejected, of near copies one stays, secrets are replaced by a mark,
the sources are mixed to their target weights (a document taken twice is two rows), and
what is left is encoded to token ids. Every stage works on what the one before it kept
and returns the columns of ``documents``; the last returns ids.

Null texts pass through as null until they are encoded to no ids.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triagelens.llm import bpe, jaccard_join, mixing, secret_scan, toxicity
from triagelens.llm.common import table, written
from triagelens.llm.queries import VOCABULARY

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject."""
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"), ~toxicity.held_out())
    return toxicity.accepted(docs.select(*COLUMNS), model)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group that similarity links join."""
    return jaccard_join.representatives(docs.select(*COLUMNS))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark, ``n_chars`` brought up to date."""
    marked = docs.select(*COLUMNS, F.col("text").isNull().alias("_null"))
    clean = secret_scan.redact(secret_scan.scan(marked, keep=("lang", "source", "n_chars", "_null")))
    changed = F.size("spans") > 0
    return clean.select(
        "doc_id",
        F.when(~F.col("_null"), F.col("text")).alias("text"),
        "lang",
        "source",
        F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"),
    )


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many rows of each document as copies of it are taken."""
    mixed = mixing.mix(docs.select(*COLUMNS), keep=("text", "lang", "n_chars"))
    copies = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))
    return mixed.where("copies > 0").withColumn("_copy", copies).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids: ``doc_id, text_key, part, n_tokens, ids``; see ``bpe.encode``."""
    ids = bpe.encode(docs, VOCABULARY, public_tokenizers.PATTERN)
    return ids.withColumn("n_tokens", F.size("ids")).select("doc_id", "text_key", "part", "n_tokens", "ids")


STAGES = [
    ("toxicity", reject_toxic),
    ("n-gram Jaccard join", one_of_near_copies),
    ("secret scans", redact_secrets),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE", encode),
]

# Learned models, components and tokenizers are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
