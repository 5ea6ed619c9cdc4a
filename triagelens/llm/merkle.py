"""Merkle manifest of a dataset, verified by a recursive query that climbs from the leaves.

Every document is a leaf. The leaves of a source stand in the order of their ids; every
``FANOUT`` consecutive nodes become one node of the next level until one is left, the
source's subroot, and the subroots of all sources, in the order of the sources, are
built up to the root in the same way.

* **Numbering.** The leaves are dealt by ranges of (source, id); a position is an offset
  in its range plus the rows of the source in earlier ranges, so no source is sorted in
  one place.
* **Levels** are grouped by (tree, position / ``FANOUT``): no group has more than
  ``FANOUT`` rows, each level is a sixteenth of the one below. The built nodes are kept
  as rows that name their parent and their place among its children.
* **Climb.** A recursive query ascends from every leaf. The leaves of one run stand in one
  row, since all nodes above the run are the same for them: what ascends is the hash of
  each leaf (the tampered one where there is one), folded with the siblings met on the
  way, and the siblings themselves, appended. A node near the root is met by rows of the
  whole tree; it is stored in as many copies as there are ``CLIMBERS`` rows below it, and
  rows are dealt over the copies by hash.

Defined results: a null field is hashed as ``-``; a null source is a source, the first
one; null ids stand first in their source and are not tampered with; rows of one id stand
in the order of their leaf hashes, so repeated rows, whose leaves are equal, are leaves
each; an empty text is hashed as ``0:``; an empty table gives an empty result. Further
columns are not part of a leaf.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from triagelens.llm.common import crc32_mod, pieces, ranged, written

FANOUT = 16
CLIMBERS = 4096  # rows that meet one copy of a node, about
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TAMPER_EVERY = 5
DIGITS = 64  # of a hash
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def field(column: Column) -> Column:
    """Byte count, colon and value; a dash for null."""
    value = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_hash(*columns: Column) -> Column:
    return sha256(F.concat(*[field(c) for c in columns]))


def leaves(docs: DataFrame) -> DataFrame:
    """``source, doc_id, leaf, tampered, row``: the hash of each document, and that of its
    lower-cased form for the documents that are tampered with, else null."""
    plain = [F.col(c) for c in FIELDS]
    lowered = [*plain[:-1], F.translate("text", UPPER, LOWER)]
    chosen = crc32_mod(F.col("doc_id"), TAMPER_EVERY) == 0
    return docs.select(
        F.col("source").cast("string").alias("source"),
        F.col("doc_id").cast("long").alias("doc_id"),
        leaf_hash(*plain).alias("leaf"),
        F.when(chosen, leaf_hash(*lowered)).alias("tampered"),
        F.monotonically_increasing_id().alias("row"),
    )


def numbered_leaves(docs: DataFrame) -> tuple[DataFrame, int, int]:
    """``tree, idx, n, doc_id, leaf, tampered`` with the number of the source, the position
    in it and its size; the number of sources and the largest size."""
    kept = ranged(leaves(docs), ["source", "doc_id", "leaf", "row"], "leaves")
    parts = pieces(kept, "source")
    sources = parts.groupBy("source").agg(F.sum("in_part").alias("n"))
    sources = ranged(sources, ["source"], "sources")
    starts = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    before = sources.groupBy(F.shiftright("at", 33).alias("part")).agg(F.count("*").alias("c"))
    before = before.select("part", F.coalesce(F.sum("c").over(starts), F.lit(0)).alias("before"))
    offset = F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    trees = sources.join(before, F.shiftright("at", 33) == F.col("part")).select(F.col("source").alias("s"), "n", (F.col("before") + offset).alias("tree"))
    places = parts.join(trees, F.expr("source <=> s")).select("part", F.col("source").alias("s"), "first_at", "before", "n", "tree")
    joined = kept.join(places, F.expr("shiftright(at, 33) = part and source <=> s"))
    rows = joined.select("tree", (F.col("before") + F.col("at") - F.col("first_at")).alias("idx"), "n", "doc_id", "leaf", "tampered")
    count, largest = sources.agg(F.count("*"), F.max("n")).first()
    return rows, count, largest or 0


def level_up(nodes: DataFrame, kept: list[str]) -> DataFrame:
    """Runs of ``nodes``: ``tree, idx, n, members``; ``n`` is the level's number of nodes."""
    members = F.array_sort(F.collect_list(F.struct(F.col("idx").alias("place"), *kept)))
    grouped = nodes.groupBy("tree", F.floor(F.col("idx") / FANOUT).cast("long").alias("run"), "n").agg(members.alias("members"))
    return grouped.select("tree", F.col("run").alias("idx"), F.ceil(F.col("n") / FANOUT).cast("long").alias("n"), "members")


def node_of(runs: DataFrame, height: int) -> DataFrame:
    """The node that stands for each run: its children's hashes, its own, and the number of
    leaf runs below it."""
    children = F.concat_ws("", F.col("members.hash"))
    return runs.select(
        "tree", F.lit(height).alias("height"), "idx", "n", children.alias("kids"), sha256(children).alias("hash"),
        F.aggregate("members.weight", F.lit(0).cast("long"), lambda a, b: a + b).alias("weight"),
    )


def copies(weight: str) -> Column:
    return F.ceil(F.col(weight) / CLIMBERS).cast("long")


def parent_links(runs: DataFrame, height: int) -> DataFrame:
    """The members of ``runs`` as node rows that name their parent."""
    weight = F.aggregate("members.weight", F.lit(0).cast("long"), lambda a, b: a + b)
    rows = runs.select("tree", "idx", weight.alias("up_weight"), F.posexplode("members").alias("slot", "m"))
    return rows.select(
        F.col("m.node.*"), "m.hash", "m.weight",
        F.col("tree").alias("up_tree"), F.lit(height).alias("up_height"), F.col("idx").alias("up_idx"), copies("up_weight").alias("up_copies"), "slot",
    )


def build(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The runs of leaves (``tree, idx, members``) and the table of nodes above them."""
    base, sources, largest = numbered_leaves(docs)
    carried = F.coalesce("tampered", "leaf").alias("carried")
    runs = written(level_up(base, ["doc_id", "leaf", carried]), "runs")
    alone = (F.size("members") == 1) & (F.col("idx") == 0)  # the only leaf of its source is the subroot
    children = F.concat_ws("", F.col("members.leaf"))
    level = runs.select(
        "tree", F.lit(1).alias("height"), "idx", "n",
        F.when(~alone, children).alias("kids"),
        F.when(alone, F.col("members.leaf")[0]).otherwise(sha256(children)).alias("hash"),
        F.lit(1).cast("long").alias("weight"),
    )
    stored = F.struct("tree", "height", F.col("idx"), "kids", F.lit(False).alias("is_subroot")).alias("node")
    top = F.struct("tree", "height", F.col("idx"), "kids", F.lit(True).alias("is_subroot")).alias("node")
    links, tops, height, widest = [], level.where("n = 1"), 1, -(-largest // FANOUT)
    while widest > 1:
        height, widest = height + 1, -(-widest // FANOUT)
        above = written(level_up(level.where("n > 1").withColumn("node", stored), ["hash", "weight", "node"]), "level")
        links.append(parent_links(above, height))
        level = node_of(above, height)
        tops = tops.unionByName(level.where("n = 1"))
    tops = tops.withColumn("node", top)
    # The tree of the subroots, number -1.
    level, height = tops.select(F.lit(-1).cast("long").alias("tree"), F.col("tree").alias("idx"), F.lit(sources).cast("long").alias("n"), "hash", "weight", "node"), 0
    remaining = sources
    while remaining > 1:
        height += 1
        above = written(level_up(level, ["hash", "weight", "node"]), "level")
        links.append(parent_links(above, height))
        remaining = -(-remaining // FANOUT)
        level = node_of(above, height).withColumn("node", stored)
    nothing = [F.lit(None).cast(t).alias(c) for c, t in (("up_tree", "long"), ("up_height", "int"), ("up_idx", "long"), ("up_copies", "long"), ("slot", "int"))]
    nodes = level.select("node.*", "hash", "weight", *nothing)
    for more in links:
        nodes = nodes.unionByName(more)
    salted = nodes.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(copies("weight"), F.lit(1).cast("long")) - 1)))
    return runs, written(salted.drop("weight"), "nodes")


CLIMB = f"""
    WITH RECURSIVE climb(tree, run, folds, proof, subroot, root, at_tree, at_height, at_idx, salt, slot) AS (
        SELECT tree, idx, transform(members, m -> m.carried), CAST('' AS STRING), CAST(NULL AS STRING), CAST(NULL AS STRING),
            tree, 1, idx, CAST(0 AS BIGINT), CAST(NULL AS INT)
        FROM {{runs}}
        UNION ALL
        SELECT c.tree, c.run,
            CASE WHEN n.kids IS NULL THEN c.folds ELSE transform(c.folds, (f, j) -> sha2(concat(
                substring(n.kids, 1, {DIGITS} * coalesce(c.slot, j)), f, substring(n.kids, {DIGITS} * coalesce(c.slot, j) + {DIGITS + 1})), 256)) END,
            CASE WHEN c.slot IS NULL THEN c.proof ELSE concat(
                c.proof, substring(n.kids, 1, {DIGITS} * c.slot), substring(n.kids, {DIGITS} * c.slot + {DIGITS + 1})) END,
            coalesce(c.subroot, CASE WHEN n.is_subroot THEN n.hash END),
            CASE WHEN n.up_tree IS NULL THEN n.hash END,
            n.up_tree, n.up_height, n.up_idx, pmod(xxhash64(c.tree, c.run), n.up_copies), n.slot
        FROM climb c JOIN {{nodes}} n
            ON c.at_tree = n.tree AND c.at_height = n.height AND c.at_idx = n.idx AND c.salt = n.salt)
    SELECT tree, run, folds, proof, subroot, root FROM climb WHERE root IS NOT NULL"""


def climbed(runs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``tree, run, folds, proof, subroot, root`` of every run: the folded hash of each of
    its leaves at the root, and the siblings above the run, level by level."""
    spark = runs.sparkSession
    key = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "-1")
    try:
        return written(spark.sql(CLIMB, runs=runs, nodes=nodes), "climbed")
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def manifest(docs: DataFrame) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` of every row."""
    runs, nodes = build(docs)
    up = climbed(runs, nodes).withColumnsRenamed({"tree": "t"})
    rows = runs.join(up, F.expr("tree = t and idx = run"))
    rows = rows.select("folds", "proof", "subroot", "root", F.concat_ws("", F.col("members.leaf")).alias("kids"), F.posexplode("members").alias("j", "m"))
    left = F.expr(f"substring(kids, 1, {DIGITS} * j)")
    right = F.expr(f"substring(kids, {DIGITS} * j + {DIGITS + 1})")
    folded = F.col("folds")[F.col("j")]
    return rows.select(
        "m.doc_id", "m.leaf", "subroot", "root", sha256(F.concat(left, right, "proof")).alias("proof_sha256"),
        folded.alias("folded_root"), (folded == F.col("root")).alias("verified"),
    )
