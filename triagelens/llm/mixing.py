"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target number of words, and every document an expected number of
copies: proportional to its weight, at most ``MAX_COPIES``, and such that the source's
expected words are its target (what documents at the limit cannot take goes to the others
by weight). The whole part of it is allocated as certain copies, the fraction is the
inclusion probability of one more. That one more copy is drawn by Pareto order sampling: a
document has a fixed random number ``u`` and the ranking variable
``odds(u) / odds(inclusion probability)``; within each source the documents of lowest rank
are taken until the words left are used up, so the sample's size is fixed rather than
random. Weights are grouped into classes of a ratio of ``2 ** (1 / STEPS)``; by default a
document's weight follows its length (``length_weight``): shorter documents are taken less.

Only ids, sources, sizes and weights are shuffled. The ranking is cut without sorting a
source: documents fall into ``BINS`` bins by rank, running sums go over one row per
(source, bin), and only the bin at the cut is ordered. What remains is one row per source,
the last key that is taken, and with it the documents are passed once where they lie, texts
included.

Defined results: a null text has size 0 and is taken 0 times; null sources are one
source, the last in order; a null or non-positive weight counts as the least class;
repeated rows are documents of their own (equal keys tie, and it does not matter which of
them is taken); an empty table gives an empty result. All random numbers are hashes of the
id, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from triagelens.llm.common import BLANKS, pieces, ranged, written

WEIGHTS = (5, 2, 1)  # of the sources in code point order, repeating
MAX_COPIES = 3
BINS = 4096
STEPS = 4  # weight classes per doubling
CLASSES = (-80, 80)  # the least and the largest one
LENGTHS = ((50, 1.0), (200, 2.0), (None, 4.0))  # words below which a document has this weight
SEED = 7


def word_count(text: Column) -> Column:
    """Number of runs of characters other than blanks."""
    spaced = F.translate(F.coalesce(text, F.lit("")), BLANKS, " " * len(BLANKS))
    # A word starts at a non-blank after a blank: drop everything but such borders.
    return F.when(F.trim(spaced) == "", F.lit(0)).otherwise(
        F.size(F.split(F.trim(spaced), " +"))
    ).cast("long")


def uniform(id_column: Column, seed: int = SEED) -> Column:
    """A number strictly between 0 and 1 that depends on the id and the seed only."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_column.cast("string"), F.lit("")))), 1, 12)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(1 << 48))


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """``source, source_size, target`` for a table of documents' ``source, size``.

    Sources at their limit stop there and what they cannot take is shared by weight
    among the rest. Sorted by limit per weight, the sources at their limit are the
    first ones: source k is at it if the common level, computed with all sources
    before it at their limits, reaches its own limit. One row per source is ordered.
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = per_source.withColumn("_rank", F.row_number().over(by_name) - 1)
    choice = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    weighed = weighed.withColumn("_weight", choice).withColumn("_limit", (max_copies * F.col("source_size")).cast("double"))
    by_limit = Window.orderBy(F.col("_limit") / F.col("_weight"), "_rank")
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    level = (
        F.sum("source_size").over(everything).cast("double") - F.coalesce(F.sum("_limit").over(before), F.lit(0.0))
    ) / (F.sum("_weight").over(everything) - F.coalesce(F.sum("_weight").over(before), F.lit(0.0)))
    levelled = weighed.withColumn("_level", level).withColumn("_k", F.row_number().over(by_limit))
    # The first source that is below its limit fixes the level for it and all after it.
    below = F.col("_level") * F.col("_weight") < F.col("_limit")
    levelled = levelled.withColumn("_open", F.min(F.when(below, F.col("_k"))).over(everything))
    shared = F.max(F.when(F.col("_k") == F.col("_open"), F.col("_level"))).over(everything)
    target = F.when(F.col("_k") >= F.col("_open"), shared * F.col("_weight")).otherwise(F.col("_limit"))
    return levelled.select("source", "source_size", target.alias("target"))


def length_weight(size: Column) -> Column:
    weight = None
    for below, value in LENGTHS:
        if weight is None:
            weight = F.when(size < below, value)
        else:
            weight = weight.otherwise(value) if below is None else weight.when(size < below, value)
    return weight


def weight_class(weight: Column) -> Column:
    """The class whose weight is ``2 ** (class / STEPS)``."""
    low, high = CLASSES
    place = F.round(F.log2(weight.cast("double")) * STEPS)
    return F.least(F.greatest(F.coalesce(F.when(weight > 0, place), F.lit(float(low))), F.lit(float(low))), F.lit(float(high))).cast("int")


def expected_copies(rows: DataFrame, goals: DataFrame, max_copies: int = MAX_COPIES) -> DataFrame:
    """``source, class, expected, source_size, target``: copies of a document of each class.

    Sorted by weight, the classes at the limit are the heaviest ones: a class is at it if
    the level that all classes heavier than it at the limit leave reaches its own limit.
    """
    masses = rows.groupBy("source", "class").agg(F.sum("size").alias("mass"))
    masses = masses.join(goals.withColumnRenamed("source", "_s"), F.expr("source <=> _s")).drop("_s")
    masses = masses.withColumn("w", F.pow(F.lit(2.0), F.col("class") / STEPS))
    heavier = Window.partitionBy("source").orderBy(F.desc("class"))
    before = heavier.rowsBetween(Window.unboundedPreceding, -1)
    after = heavier.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    left = F.col("target") - max_copies * F.coalesce(F.sum("mass").over(before), F.lit(0))
    masses = masses.withColumn("level", left / F.nullif(F.sum(F.col("w") * F.col("mass")).over(after), F.lit(0.0)))
    # The heaviest class below its limit fixes the level for it and all lighter ones.
    open_class = F.max(F.when(F.col("level") * F.col("w") < max_copies, F.col("class"))).over(Window.partitionBy("source"))
    masses = masses.withColumn("open", open_class)
    shared = F.max(F.when(F.col("class") == F.col("open"), F.col("level"))).over(Window.partitionBy("source"))
    expected = F.when(F.col("class") <= F.col("open"), F.least(shared * F.col("w"), F.lit(float(max_copies)))).otherwise(F.lit(float(max_copies)))
    return masses.select("source", "class", expected.alias("expected"), "source_size", "target")


# What a document's place in its source's order is; equal keys tie.
KEY = ("rank", "no_id", "id", "size")


def ranked(rows: DataFrame, copies: DataFrame, seed: int) -> DataFrame:
    """``rows`` with ``whole``, ``p`` and the key by which the one more copy is drawn."""
    joined = rows.join(copies.withColumnsRenamed({"source": "_s", "class": "_c"}), F.expr("source <=> _s and class = _c")).drop("_s", "_c")
    u = uniform(F.col("doc_id"), seed)
    return (
        joined.withColumn("whole", F.floor("expected"))
        .withColumn("p", F.col("expected") - F.col("whole"))
        .withColumn("rank", F.when((F.col("p") > 0) & (F.col("size") > 0), (u / (1 - u)) * (1 - F.col("p")) / F.col("p")))
        .withColumn("no_id", F.col("doc_id").isNull())
        .withColumn("id", F.coalesce("doc_id", F.lit(0).cast("long")))
    )


def cuts(order: DataFrame, bins: int) -> DataFrame:
    """The last key that each source takes, as ``_source, cut, m, t``: all before it are
    taken, of the ``t`` documents that have it ``m`` are. No row where none is taken."""
    # rank / (1 + rank) lies between 0 and 1 and keeps the order
    place = F.least(F.floor(F.col("rank") / (1 + F.col("rank")) * bins), F.lit(bins - 1)).cast("int")
    binned = order.withColumn("bin", F.coalesce(place, F.lit(-1)))
    budget = binned.groupBy("source", "bin").agg(
        F.sum(F.when(F.col("rank").isNotNull(), F.col("size")).otherwise(0)).alias("words"),
        F.sum(F.col("whole") * F.col("size")).alias("sure"),
        F.first("target").alias("target"),
    )
    of_source = Window.partitionBy("source")
    upto = of_source.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("target") - F.sum("sure").over(of_source) - F.coalesce(F.sum("words").over(upto), F.lit(0))
    budget = budget.withColumn("left", left).where("bin >= 0 and words > 0 and left > 0")
    # The last bin with words left holds the cut, or ends before it.
    last = budget.groupBy(F.col("source").alias("_s")).agg(F.max(F.struct("bin", "left")).alias("b"))
    last = last.select("_s", F.col("b.bin").alias("_bin"), F.col("b.left").alias("left"))
    inside = binned.join(last, F.expr("source <=> _s and bin = _bin")).groupBy("source", *KEY).agg(F.count("*").alias("t"), F.first("left").alias("left"))
    before = F.coalesce(F.sum(F.col("t") * F.col("size")).over(Window.partitionBy("source").orderBy(*KEY).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # A document is taken if the words left reach its middle.
    fits = F.floor((F.col("left") - before) / F.col("size") + 0.5)
    taken = inside.withColumn("m", F.least(F.greatest(fits, F.lit(0)), F.col("t")).cast("long"))
    at = taken.where("m > 0").groupBy("source").agg(F.max(F.struct(*KEY, "m", "t")).alias("cut"))
    # Where the first document of that bin does not fit, all of the bins before it are taken.
    at = last.join(at, F.expr("source <=> _s"), "left")
    return at.select(
        F.col("_s").alias("_source"), F.col("_bin"), F.when(F.col("cut").isNotNull(), F.struct(*[f"cut.{k}" for k in KEY])).alias("cut"),
        F.coalesce("cut.m", F.lit(0)).alias("m"), F.coalesce("cut.t", F.lit(0)).alias("t"),
    )


def mix(
    docs: DataFrame,
    weights: tuple = WEIGHTS,
    max_copies: int = MAX_COPIES,
    seed: int = SEED,
    bins: int = BINS,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weight_col: str | None = None,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """``doc_id, source, size, source_size, target, copies, taken`` of every row.

    ``keep`` names further columns to carry; they are not shuffled.
    """
    weight = F.col(weight_col) if weight_col else length_weight(F.col("size"))
    # A projection of its own: the words are counted once, however often the size is used.
    sized = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), *keep, *([weight_col] if weight_col and weight_col not in keep else [])
    )
    sized = sized.select("doc_id", "source", "size", weight_class(weight).alias("class"), *keep)
    rows = written(sized.drop(*keep), "mix")
    goals = written(targets(rows.select("source", "size"), weights, max_copies), "goals")
    copies = written(expected_copies(rows, goals, max_copies), "expected")
    cut = written(cuts(ranked(rows, copies, seed), bins), "cuts")
    order = ranked(sized if keep else rows, copies, seed).join(cut, F.expr("source <=> _source"), "left")
    place = F.least(F.floor(F.col("rank") / (1 + F.col("rank")) * bins), F.lit(bins - 1)).cast("int")
    key = F.struct(*KEY)
    chosen = F.col("rank").isNotNull() & F.coalesce((place < F.col("_bin")) | (key <= F.col("cut")), F.lit(False))
    tied = F.coalesce((key == F.col("cut")) & (F.col("m") < F.col("t")), F.lit(False))
    decided = order.withColumn("more", chosen).withColumn("tied", tied)
    if not cut.where("m < t and m > 0").isEmpty():
        # Of documents with one key some are taken: they are numbered.
        some = decided.where("tied").withColumn("row", F.monotonically_increasing_id())
        some = ranged(some, ["source", "row"], "ties")
        first = pieces(some, "source").select("part", F.col("source").alias("_s"), "first_at", "before")
        some = some.join(first, F.expr("shiftright(at, 33) = part and source <=> _s"))
        some = some.withColumn("more", F.col("before") + F.col("at") - F.col("first_at") < F.col("m"))
        decided = decided.where("not tied").unionByName(some.select(*decided.columns))
    number = F.least(F.col("whole") + F.col("more").cast("long"), F.lit(max_copies))
    return decided.withColumn("copies", F.when(F.col("size") > 0, number).otherwise(F.lit(0)).cast("long")).select(
        "doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *keep
    )
