"""Secret scans over a trigram inverted index.

Each rule's regular expression is turned into a Boolean query over trigrams: the
strings that every match must contain, alternatives of an alternation joined by OR,
the trigrams of one string by AND. The index holds, for every trigram that some rule
asks for, the ids of the documents that contain it. A rule's postings are intersected
to its candidate documents, and only those are searched with the expression itself.
A rule without mandatory trigrams (a bare character class) searches every document.

Trigrams are taken from the lower-cased text, so case never hides a candidate.

Spans are code point offsets, end exclusive, leftmost and not overlapping within one
kind. Base kinds and added kinds are independent of each other.

Defined results: a null text is empty and has no spans; repeated rows each get their
own spans (an id that occurs with several texts shares its candidates, which costs
time but changes nothing); null ids match null ids; an empty table gives an empty
result. Further columns are not looked at unless named in ``keep``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from triagelens.llm.common import documents, written


@dataclass(frozen=True)
class Rule:
    """``group`` of each match must have ``min_length`` characters; 0 is the whole match."""

    kind: str
    pattern: str
    group: int = 0
    min_length: int = 1


# The three base kinds in their order.
BASE_RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)
ADDED_RULES = (
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ ){0,3}PRIVATE KEY-----"),
    Rule("code_host", r"gh[pousr]_[A-Za-z0-9]{36,255}"),
    Rule("chat_bot", r"xox[abprs]-[A-Za-z0-9-]{10,255}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
)
RULES = BASE_RULES + ADDED_RULES

MAX_STRINGS = 64  # alternatives of one mandatory string before it is given up


# ------------------------------------------------------------ expression to query


def _strings(items) -> list[set[str] | None]:
    """The items of a parsed expression as runs: a set of possible strings, or None
    where anything may stand."""
    from re import _constants as c

    out: list[set[str] | None] = []

    def put(part: set[str] | None) -> None:
        if part is not None and out and out[-1] is not None and len(out[-1]) * len(part) <= MAX_STRINGS:
            out[-1] = {a + b for a, b in product(out[-1], part)}
        else:
            out.append(part)

    for kind, value in items:
        if kind is c.LITERAL:
            put({chr(value).lower()})
        elif kind is c.IN and all(k is c.LITERAL for k, _ in value) and len(value) <= 8:
            put({chr(v).lower() for _, v in value})
        elif kind is c.SUBPATTERN:
            for part in _strings(value[-1]):
                put(part)
        elif kind is c.BRANCH:
            runs = [_strings(branch) for branch in value[1]]
            put(set().union(*(r[0] for r in runs)) if all(len(r) == 1 and r[0] for r in runs) else None)
        elif kind is c.MAX_REPEAT and value[:2] == (0, 1):
            inner = _strings(value[2])
            put({""} | inner[0] if len(inner) == 1 and inner[0] else None)
        elif kind is c.MAX_REPEAT and value[0] >= 1:
            for part in _strings(value[2]):
                put(part)
            if value[1] > 1:
                put(None)
        else:
            put(None)
    return out


def trigram_query(pattern: str) -> list[list[list[str]]]:
    """AND of clauses; a clause is an OR of alternatives; an alternative an AND of
    trigrams. Empty if nothing is mandatory."""
    from re import _parser

    clauses = []
    for strings in _strings(_parser.parse(pattern)):
        if strings and all(len(s) >= 3 for s in strings):
            clauses.append([sorted({s[i : i + 3] for i in range(len(s) - 2)}) for s in sorted(strings)])
    return clauses


def trigrams_of(rules: tuple[Rule, ...]) -> list[str]:
    return sorted({t for rule in rules for clause in trigram_query(rule.pattern) for alt in clause for t in alt})


# ---------------------------------------------------------------- index and candidates


def build_index(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Postings ``trigram, doc_id`` for the trigrams that ``rules`` ask for."""
    wanted = F.array(*[F.lit(t) for t in trigrams_of(rules)])
    present = F.get(
        F.transform(F.array(F.lower("text")), lambda text: F.filter(wanted, lambda t: F.contains(text, t))), F.lit(0)
    )
    return documents(docs).select(F.explode(present).alias("trigram"), "doc_id")


def candidates(spark: SparkSession, postings: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``doc_id, kinds``: the rules whose postings intersect in the document."""
    rows = [
        (rule.kind, c, a, len(alternative), trigram)
        for rule in rules
        for c, clause in enumerate(trigram_query(rule.pattern))
        for a, alternative in enumerate(clause)
        for trigram in alternative
    ]
    clauses = {rule.kind: len(trigram_query(rule.pattern)) for rule in rules}
    query = spark.createDataFrame(rows, "kind string, clause int, alternative int, needed int, trigram string")
    hits = (
        postings.join(F.broadcast(query), "trigram")  # one row per trigram of the rules
        .groupBy("doc_id", "kind", "clause", "alternative", "needed")
        .agg(F.count_distinct("trigram").alias("found"))
        .where("found = needed")
    )
    needed = F.create_map(*[F.lit(x) for pair in clauses.items() for x in pair])
    return (
        hits.groupBy("doc_id", "kind")
        .agg(F.count_distinct("clause").alias("clauses"))
        .where(F.col("clauses") == F.element_at(needed, F.col("kind")))
        .groupBy("doc_id")
        .agg(F.collect_set("kind").alias("kinds"))
    )


# ------------------------------------------------------------------------------ spans

RUN = 256


def running_sum(values: Column) -> Column:
    """Prefix sums of an int array, by runs so that long arrays stay nearly linear."""
    empty = F.array().cast("array<int>")

    def extend(acc: Column, x: Column) -> Column:
        return F.concat(acc, F.array(F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(0)) + x))

    runs = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(values) - 1) / RUN).cast("int")),
        lambda k: F.aggregate(F.slice(values, k * RUN + 1, RUN), empty, extend),
    )
    joined = F.aggregate(
        runs,
        empty,
        lambda acc, run: F.concat(
            acc, F.transform(run, lambda x: x + F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(0)))
        ),
    )
    return F.when(F.size(values) == 0, empty).otherwise(joined)


def spans_of(text: Column, rule: Rule, rank: int) -> Column:
    """Spans of one rule as structs ``start, rank, kind, end``.

    The text split at the matches gives the stretches between them, so their lengths
    and those of the matches add up to the positions.
    """
    pattern = F.lit(rule.pattern)
    if rule.kind == "hex":  # most runs are single letters: search the long ones only
        pattern = F.lit(r"[0-9a-f]{24,}")
    matches = F.regexp_extract_all(text, pattern, F.lit(0))
    checked = F.regexp_extract_all(text, pattern, F.lit(rule.group))
    gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(matches))

    def located(found: Column) -> Column:
        steps = F.transform(
            F.arrays_zip(gaps.alias("g"), F.concat(F.array(F.lit("")), found).alias("m")),
            lambda x: F.length(x["g"]) + F.length(x["m"]),
        )
        starts = running_sum(F.slice(steps, F.lit(1), F.size(found)))
        return F.transform(
            F.arrays_zip(starts.alias("s"), found.alias("m"), checked.alias("v")),
            lambda x: F.struct(
                x["s"].alias("start"),
                F.lit(rank).alias("rank"),
                F.lit(rule.kind).alias("kind"),
                (x["s"] + F.length(x["m"])).alias("end"),
                F.length(x["v"]).alias("length"),
            ),
        )

    kept = F.filter(located(matches), lambda s: s["length"] >= rule.min_length)
    empty = F.array().cast(SPANS)
    bare = F.transform(kept, lambda s: F.struct(s["start"], s["rank"], s["kind"], s["end"])).cast(SPANS)
    return F.when(F.rlike(text, pattern), bare).otherwise(empty)


SPANS = "array<struct<start:int,rank:int,kind:string,end:int>>"


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, text, spans`` of every row, spans ordered by start, then rule."""
    spark = docs.sparkSession
    indexed = tuple(rule for rule in rules if trigram_query(rule.pattern))
    found = candidates(spark, build_index(docs, indexed), indexed).withColumnRenamed("doc_id", "_id")
    rows = documents(docs, *keep)
    joined = rows.join(found, rows["doc_id"].eqNullSafe(found["_id"]), "left")
    lists = []
    for rank, rule in enumerate(rules):
        spans = spans_of(F.col("text"), rule, rank)
        if rule in indexed:
            spans = F.when(F.array_contains("kinds", rule.kind), spans).otherwise(F.array().cast(SPANS))
        lists.append(spans)
    return joined.select("doc_id", "text", *keep, F.sort_array(F.concat(*lists)).alias("spans"))


def spans_text(spans: Column) -> Column:
    """``kind:start:end`` joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(scanned: DataFrame) -> DataFrame:
    """``doc_id``, counts of the base kinds, hash of the base spans, all spans."""
    base = F.filter("spans", lambda s: s["rank"] < len(BASE_RULES))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return scanned.select(
        "doc_id",
        *[count(rule.kind) for rule in BASE_RULES],
        F.sha2(spans_text(base), 256).alias("base_sha256"),
        spans_text(F.col("spans")).alias("spans"),
    )


def redact(scanned: DataFrame, mark: str = "[secret]") -> DataFrame:
    """Scanned rows with every span replaced by ``mark`` in ``text``; overlapping and
    touching spans become one mark."""
    merged = F.aggregate(
        "spans",
        F.array().cast("array<struct<start:int,end:int>>"),
        lambda acc, s: F.when(
            F.get(acc, F.size(acc) - 1)["end"] >= s["start"],
            F.concat(
                F.slice(acc, F.lit(1), F.size(acc) - 1),
                F.array(
                    F.struct(
                        F.get(acc, F.size(acc) - 1)["start"].alias("start"),
                        F.greatest(F.get(acc, F.size(acc) - 1)["end"], s["end"]).alias("end"),
                    )
                ),
            ),
        ).otherwise(F.concat(acc, F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"))))),
    )

    def clean(ranges: Column) -> Column:
        between = F.transform(
            F.sequence(F.lit(0), F.size(ranges)),
            lambda i: F.substring(
                F.col("text"),
                F.coalesce(F.get(ranges, i - 1)["end"], F.lit(0)) + 1,
                F.coalesce(F.get(ranges, i)["start"], F.length("text")) - F.coalesce(F.get(ranges, i - 1)["end"], F.lit(0)),
            ),
        )
        return F.array_join(between, mark)

    text = F.when(F.size("spans") == 0, F.col("text")).otherwise(
        F.get(F.transform(F.array(merged), clean), F.lit(0))
    )
    return scanned.withColumn("text", text)
