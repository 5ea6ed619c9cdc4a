"""Toxicity by a lexicon, misspellings included, and the words around each hit.

The lexicon is learned from labelled documents: words, and word beginnings, that occur
in toxic documents far more often than chance allows. It is kept as a trie. A word is
looked up by running it through the intersection of the trie with a Levenshtein
automaton: the states reached are sets of (trie node, edits so far), made on demand and
remembered, so that most words die after a few table steps. Five or more letters
tolerate one edit, nine or more two; word beginnings tolerate none.

Each hit is then judged by its context window: inside quotation marks or after a
reporting word it counts as quotation, next to other hits as abuse. An entry found
once, twice or three times outside of quotations is trusted as much as labelled
documents with as many of it, relative to their length, were toxic; misspelled and quoted hits are trusted as much
as documents with nothing better were. An entry that is trusted less than ``MIN_TRUST``
at its level counts for nothing: a single word that begins oddly is no evidence, while
several of them are. A document's score is its largest trust, without
hits the rate of toxic documents among labelled ones without hits.

Defined results: null and empty texts are scored as texts without hits; a null id is
never held out nor labelled; several labels of one id count as toxic if one of them is;
repeated rows are each scored; without labels every score is the prior of no hit; an
empty table gives an empty result. Only id and text of a document are read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from triagelens.llm.common import crc32_mod, documents, small_batches, written

LABELLED = 20_000  # labelled rows to learn from, about; chosen by hash
LEXICON = 4_000  # entries at most, the strongest first
STEMS = (4, 5, 6, 7)  # lengths of word beginnings that can be entries
PRECISION = 0.8  # least share of toxic documents among those with an entry
MIN_TRUST = 0.7  # an entry at a level that is trusted less says nothing
WINDOW = 8  # words on either side
THRESHOLD = 0.3
WORDS_KEPT = 500_000  # tokens a worker remembers to have looked into
HEAD = 4  # first letters whose state is remembered
STATES_KEPT = 50_000

# Words that introduce somebody else's speech.
REPORTING = frozenset("said says quote quoted quotes wrote writes called calls calling term word insult slur".split())
QUOTES = {'"': '"', "“": "”", "„": "“", "«": "»", "‹": "›"}

# Kinds of hits, the strongest first, with the trust they start from.
KINDS = ("exact", "misspelled among hits", "exact quoted", "misspelled alone", "misspelled quoted")
PRIOR_TRUST = (0.9, 0.6, 0.25, 0.15, 0.05)
PRIOR_WEIGHT = 5.0
LEVELS = 3  # occurrences of an entry that are told apart
DENSITY = 200  # words over which occurrences count as company for each other

WORD = re.compile(r"[^\W_]+")


def edits_allowed(term: str) -> int:
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class Matcher:
    """Trie of the lexicon and its intersection with Levenshtein automata."""

    def __init__(self, entries: Iterable[tuple[str, bool]]):
        """``entries``: terms and whether they stand for all words that begin so."""
        self.children: list[dict[str, int]] = [{}]
        self.budget = [0]  # most edits that any entry below a node allows
        self.ends: dict[int, list[tuple[int, int, bool]]] = {}
        for number, (term, stem) in enumerate(entries):
            node, allowed = 0, 0 if stem else edits_allowed(term)
            self.budget[0] = max(self.budget[0], allowed)
            for letter in term:
                if letter not in self.children[node]:
                    self.children[node][letter] = len(self.children)
                    self.children.append({})
                    self.budget.append(0)
                node = self.children[node][letter]
                self.budget[node] = max(self.budget[node], allowed)
            self.ends.setdefault(node, []).append((number, allowed, stem))
        self.clear()

    def clear(self) -> None:
        self.states: dict[tuple, int] = {}
        self.sets: list[dict[int, int]] = []
        self.found: list[tuple[list, list]] = []
        self.steps: list[dict[str, int]] = []
        self.heads: dict[str, tuple[int, list[int]]] = {}  # by first letters
        self.seen: set[str] = set()  # tokens that were looked into
        self.hitting: dict[str, dict] = {}  # those of them with hits, and the hits
        self.start = self.state({0: 0})

    def state(self, nodes: dict[int, int]) -> int:
        """Number of the state that holds ``nodes`` and all reached by leaving letters out."""
        todo = list(nodes)
        while todo:
            node = todo.pop()
            edits = nodes[node] + 1
            for child in self.children[node].values():
                if edits <= self.budget[child] and edits < nodes.get(child, 99):
                    nodes[child] = edits
                    todo.append(child)
        key = tuple(sorted(nodes.items()))
        number = self.states.get(key)
        if number is None:
            number = self.states[key] = len(self.sets)
            here = [(e, entry, stem) for n, e in nodes.items() for entry, allowed, stem in self.ends.get(n, ()) if e <= allowed]
            self.sets.append(nodes)
            self.found.append(([(e, x) for e, x, stem in here if not stem], [x for _, x, stem in here if stem]))
            self.steps.append({})
        return number

    def step(self, state: int, letter: str) -> int:
        nodes: dict[int, int] = {}

        def reach(node: int, edits: int) -> None:
            if edits <= self.budget[node] and edits < nodes.get(node, 99):
                nodes[node] = edits

        for node, edits in self.sets[state].items():
            same = self.children[node].get(letter)
            if same is not None:
                reach(same, edits)
            reach(node, edits + 1)
            for child in self.children[node].values():
                reach(child, edits + 1)
        number = self.state(nodes) if nodes else -1
        self.steps[state][letter] = number
        return number

    def look_up(self, word: str) -> tuple[int, list[int]] | None:
        """Edits and entries of ``word``: all it equals or begins with, else the closest."""
        head = word[:HEAD]
        found = self.heads.get(head)
        if found is None:
            found = self.heads[head] = self.walk(self.start, head)
        state, entries = found
        if state >= 0 and len(word) > HEAD:
            state, more = self.walk(state, word[HEAD:])
            entries = entries + more
        whole = self.found[state][0] if state >= 0 else []
        entries = entries + [x for e, x in whole if not e]
        if entries:
            return 0, entries
        return (min(whole)[0], [min(whole)[1]]) if whole else None

    def walk(self, state: int, letters: str) -> tuple[int, list[int]]:
        """State after ``letters`` (-1: none is left) and stems passed on the way."""
        entries: list[int] = []
        for letter in letters:
            following = self.steps[state].get(letter)
            state = self.step(state, letter) if following is None else following
            if state < 0:
                break
            entries += self.found[state][1]
        return state, entries

    def hits(self, text: str) -> dict[str, tuple[int, list[int]]]:
        """The words of ``text`` that are hits. Each different token (a stretch between
        blanks, which holds whole words) is looked into once."""
        tokens = set(text.split())
        new = tokens - self.seen
        if new:
            if len(self.sets) > STATES_KEPT or len(self.seen) > WORDS_KEPT:
                self.clear()
                new = tokens
            for token in new:
                for word in (token,) if token.isalnum() else WORD.findall(token):
                    hit = self.look_up(word)
                    if hit is not None:
                        self.hitting.setdefault(token, {})[word] = hit
            self.seen |= new
        if tokens.isdisjoint(self.hitting):
            return {}
        return {word: hit for token in tokens.intersection(self.hitting) for word, hit in self.hitting[token].items()}


def quoted_ranges(text: str) -> list[tuple[int, int]]:
    """Ranges between matching quotation marks of one line."""
    ranges = []
    for opening, closing in QUOTES.items():
        begin = text.find(opening)
        while begin >= 0:
            line = text.find("\n", begin)
            end = text.find(closing, begin + 1, line if line >= 0 else len(text))
            if end < 0:
                begin = text.find(opening, begin + 1) if opening != closing else text.find(opening, line) if line >= 0 else -1
                continue
            ranges.append((begin, end))
            begin = text.find(opening, end + 1)
    return sorted(ranges)


def hits_of(text: str, matcher: Matcher, window: int = WINDOW) -> tuple[int, list[tuple[int, list[int]]]]:
    """Number of words (0 without hits); every hit as its kind (an index of KINDS) and
    its entries."""
    lowered = text.lower()
    found = matcher.hits(lowered)
    if not found:
        return 0, []
    words = WORD.findall(lowered)
    places = [i for i, word in enumerate(words) if word in found]
    ranges, at = quoted_ranges(lowered), 0
    begins = [m.start() for m in WORD.finditer(lowered)] if ranges else []
    hits = []
    for k, i in enumerate(places):
        quoted = False
        if ranges:
            while at < len(ranges) and ranges[at][1] < begins[i]:
                at += 1
            quoted = at < len(ranges) and ranges[at][0] < begins[i] < ranges[at][1]
        quoted = quoted or not REPORTING.isdisjoint(words[max(0, i - window) : i])
        company = (k > 0 and i - places[k - 1] <= window) or (k + 1 < len(places) and places[k + 1] - i <= window)
        edits, entries = found[words[i]]
        if edits:
            kind = 4 if quoted else 1 if company else 3
        else:
            kind = 2 if quoted and not company else 0
        hits.append((kind, entries))
    return len(words), hits


def levels_of(words: int, hits: list[tuple[int, list[int]]]) -> dict[int, int]:
    """Level of each entry that is hit exactly and outside of quotations.

    That is the number of hits, but at most one more than there are hits for every
    DENSITY words, so that a long text does not collect chance hits; LEVELS at most.
    """
    counts: dict[int, int] = {}
    for kind, entries in hits:
        if not kind:
            for entry in entries:
                counts[entry] = counts.get(entry, 0) + 1
    return {entry: min(n, 1 + n * DENSITY // words, LEVELS) for entry, n in counts.items()}


# --------------------------------------------------------------------------- learning


def training_rows(docs: DataFrame, labels: DataFrame, learn: Column, rows: int = LABELLED) -> DataFrame:
    """Texts and labels of about ``rows`` labelled documents for which ``learn`` holds.

    All of them if there are no more; otherwise those of low hash.
    """
    labelled = (
        labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & learn)
        .groupBy(F.col("doc_id").cast("long").alias("_id"))
        .agg(F.max("toxic").alias("toxic"))
    )
    total = labelled.count()
    if total > rows:
        labelled = labelled.where(F.pmod(F.xxhash64("_id"), F.lit(1 << 30)) < int((1 << 30) * rows / total))
    # At most about ``rows`` ids, whatever the size of the tables.
    return documents(docs).join(F.broadcast(labelled), F.expr("doc_id = _id")).select("text", "toxic")


def without_shared_passages(rows: DataFrame) -> DataFrame:
    """The rows that candidates for the lexicon are counted in.

    Whatever else stands in a passage that many toxic texts share would look as if it were
    found in many of them. Texts that share much nearly always have the same smallest hash of
    a three-word window by at least one of three hash functions; of rows of one label that
    agree in one, one is counted. The trust in an entry is measured on all rows.
    """
    words = F.split(F.lower("text"), r"[^\p{L}\p{N}]+")

    def smallest(seed: int) -> Column:
        return F.get(
            F.transform(
                F.array(words),
                lambda w: F.array_min(
                    F.transform(
                        F.sequence(F.lit(0), F.greatest(F.size(w) - 3, F.lit(0))),
                        lambda i: F.xxhash64(F.lit(seed), F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)),
                    )
                ),
            ),
            F.lit(0),
        )

    keys = [f"_key{seed}" for seed in range(3)]
    keyed = written(rows.select("text", "toxic", *[smallest(i).alias(k) for i, k in enumerate(keys)]), "passages")
    for key in keys:
        # Which of the rows stays must not depend on the order they come in.
        first = F.row_number().over(Window.partitionBy("toxic", key).orderBy(*keys, F.xxhash64("text")))
        keyed = keyed.withColumn("_first", first).where("_first = 1").drop("_first")
    return keyed.select("text", "toxic")


def learn_lexicon(rows: DataFrame, size: int = LEXICON) -> list[tuple[str, bool]]:
    """Entries whose occurrence in toxic documents chance does not explain.

    The evidence of an entry is its log likelihood ratio between its own rate of toxic
    documents and the overall one; it must exceed the logarithm of the number of
    candidates, so that hardly one entry is expected by chance.
    """
    words = F.array_distinct(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"))
    words = F.filter(words, lambda w: (F.length(w) >= 3) & (F.length(w) <= 40))

    # A beginning must be shared by two different words of the document.
    def beginnings(n: int) -> Column:
        return F.transform(F.filter(words, lambda w: F.length(w) > n), lambda w: F.concat(F.substring(w, 1, n), F.lit("*")))

    stems = F.concat(*[beginnings(n) for n in STEMS])
    stems = F.get(
        F.transform(F.array(F.sort_array(stems)), lambda s: F.filter(s, lambda x, i: x == F.get(s, i - 1))), F.lit(0)
    )
    listed = rows.select(F.array_distinct(F.concat(words, stems)).alias("terms"), "toxic")
    # The rate to beat is that of the occurrences, not of the documents: toxic documents
    # may be longer, and a long document has more of everything.
    n_terms = F.size("terms")
    all_, bad = listed.agg(F.sum(n_terms), F.sum(n_terms * F.col("toxic"))).first()
    if not all_ or not bad:
        return []
    base = min(max(bad / all_, 1e-6), 1 - 1e-6)
    counts = (
        listed.select(F.explode("terms").alias("term"), "toxic")
        .groupBy("term")
        .agg(F.sum("toxic").alias("bad"), F.count("*").alias("n"))
    )
    counts = written(counts, "terms")
    rate = (F.col("bad") + 0.5) / (F.col("n") + 1)
    evidence = F.col("bad") * F.log(rate / base) + (F.col("n") - F.col("bad")) * F.log((1 - rate) / (1 - base))
    candidates = counts.count()
    counts = counts.where(rate >= PRECISION).select("term", evidence.alias("evidence"))
    bound = math.log(max(candidates, 1)) + 2
    best = counts.where(F.col("evidence") > bound).orderBy(F.desc("evidence"), "term").limit(size).collect()
    return [(r.term.removesuffix("*"), r.term.endswith("*")) for r in best]


def evidence(rows: DataFrame, entries: list[tuple[str, bool]]) -> DataFrame:
    """``entry, level, n, bad``: labelled documents with an entry at that level, and
    how many of them are toxic. Documents without such hits are counted under
    entry -1, with the kind of their strongest hit as level (-1: none)."""

    def run(batches):
        matcher = Matcher(entries)
        counts: dict[tuple[int, int], list[int]] = {}

        def put(entry, level, toxic):
            at = counts.setdefault((entry, level), [0, 0])
            at[0] += 1
            at[1] += toxic

        for batch in batches:
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                words, hits = hits_of(text, matcher)
                levels = levels_of(words, hits)
                for entry, level in levels.items():
                    put(entry, level, toxic)
                if not levels:
                    put(-1, min((kind for kind, _ in hits), default=-1), toxic)
        found = [(entry, level, n, bad) for (entry, level), (n, bad) in counts.items()]
        columns = [pa.array([r[i] for r in found], pa.int64()) for i in range(4)]
        yield pa.RecordBatch.from_arrays(columns, names=["entry", "level", "n", "bad"])

    partial = rows.mapInArrow(run, "entry long, level long, n long, bad long")
    return partial.groupBy("entry", "level").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))


class Model:
    """Lexicon, trust in entries by level and in kinds of hits, score without hits."""

    def __init__(self, entries: list[tuple[str, bool]], by_entry: list[list[float]], by_kind: list[float], none: float):
        self.entries, self.by_entry, self.by_kind, self.none = entries, by_entry, by_kind, none

    def scorer(self) -> Callable[[str], float]:
        matcher = Matcher(self.entries)

        def score(text: str) -> float:
            words, hits = hits_of(text, matcher)
            best = max((self.by_entry[e][n - 1] for e, n in levels_of(words, hits).items()), default=self.none)
            return max(best, *(self.by_kind[kind] for kind, _ in hits if kind), self.none, 0.0)

        return score


def learn(docs: DataFrame, labels: DataFrame, learn_from: Column, rows: int = LABELLED) -> Model:
    """A model from the labelled rows for which ``learn_from`` (over ``doc_id``) holds."""
    small_batches(docs.sparkSession)
    sample = written(training_rows(docs, labels, learn_from, rows), "labelled")
    entries = learn_lexicon(without_shared_passages(sample))
    counts = {(r.entry, r.level): (r.n, r.bad) for r in evidence(sample, entries).collect()}
    total, toxic = sample.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    base = (toxic + 0.5) / (total + 5.0)

    def trust(key: tuple[int, int], prior: float, weight: float) -> float:
        n, bad = counts.get(key, (0, 0))
        return (bad + prior * weight) / (n + weight)

    by_entry = []
    for entry in range(len(entries)):
        steps = [trust((entry, level), base, 0.5) for level in range(1, LEVELS + 1)]
        for level in range(1, LEVELS):  # more of an entry is never trusted less
            steps[level] = max(steps[level], steps[level - 1])
        by_entry.append([x if x >= MIN_TRUST else 0.0 for x in steps])
    by_kind = [trust((-1, kind), prior, PRIOR_WEIGHT) for kind, prior in enumerate(PRIOR_TRUST)]
    n, bad = counts.get((-1, -1), (0, 0))
    return Model(entries, by_entry, by_kind, min((bad + 0.01) / (n + 1.0), THRESHOLD / 2))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD, keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, score, predicted`` and the columns of ``keep`` for every row."""
    rows = documents(docs, *keep)
    kept = [c for c in rows.columns if c != "text"]
    types = ", ".join(f"`{c}` {t}" for c, t in rows.select(*kept).dtypes)

    def run(batches):
        scorer = model.scorer()
        for batch in batches:
            scores = [scorer(t) for t in batch.column("text").to_pylist()]
            marks = [int(s >= threshold) for s in scores]
            columns = [batch.column(c) for c in kept] + [pa.array(scores, pa.float64()), pa.array(marks, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, "score", "predicted"])

    small_batches(docs.sparkSession)
    return rows.mapInArrow(run, f"{types}, score double, predicted int")


def accepted(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns unchanged, whose score is below ``threshold``."""
    schema = docs.schema

    def run(batches):
        scorer = model.scorer()
        for batch in batches:
            texts = batch.column(text_col).to_pylist()
            yield batch.filter(pa.array([scorer(t or "") < threshold for t in texts], pa.bool_()))

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, schema)


def held_out() -> Column:
    return F.coalesce(crc32_mod(F.col("doc_id"), 4) == 2, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row; held-out labels are not learned from."""
    model = learn(docs, labels, ~held_out())
    scored = score(docs, model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")
