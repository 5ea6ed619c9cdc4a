"""Three anomaly models over session features.

Every model scores so that higher is more unusual and 0 is the 95th percentile
of the training scores, i.e. the most unusual 5 % of the training rows are
above 0.  Fitting and scoring run as Spark jobs; what reaches the driver has a
fixed bound (samples of fixed size, trees, weights, planes, boxes).
"""

from __future__ import annotations

import functools
import itertools
import json
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from triagelens.models import kernels
from triagelens.models.vectors import Scaler, feature_stats, fit_scaler, vector
from triagelens.operators.features import NUMERIC_FEATURES
from triagelens.operators.ranking import percentiles
from triagelens.operators.sessions import SESSION
from triagelens.session import lowest_hash, stage

# tasks get the kernels with the job, also where the package is not installed
cloudpickle.register_pickle_by_value(kernels)

KINDS = ("iforest", "ocsvm", "lof")
CONTAMINATION = 0.05
SEED = 42
FEATURE_VERSION = "v3-baseline-deviation"
TABLE = "point long, v array<double>, copies long, k_distance double, density double, factor double"


@dataclass
class Model:
    """Parameters, small arrays by name, the description of the training run, and what
    grows with the training rows as a table."""

    kind: str
    scaler: Scaler
    arrays: dict[str, np.ndarray]
    params: dict = field(default_factory=dict)
    metadata: dict = field(default_factory=dict)
    table: DataFrame | None = None  # of the local outlier factor: the rows it was trained on
    trained: DataFrame | None = None  # the training rows' keys and scores before the offset, where fitting finds them


def fit(features: DataFrame, kind: str, **options) -> Model:
    if kind not in KINDS:
        raise ValueError(f"Unsupported model_type: {kind}")
    scaler = fit_scaler(features)
    arrays, params, *table = {"iforest": _fit_iforest, "ocsvm": _fit_ocsvm, "lof": _fit_lof}[kind](features, scaler, **options)
    model = Model(kind, scaler, arrays, {**params, "offset": 0.0}, table=table[0] if table else None)
    if "train_offset" in params:
        model.params["offset"] = params["train_offset"]
    else:
        keys = [c for c in (*SESSION, "session_id") if c in features.columns]
        model.trained = stage(score(features, model, "raw").select(*keys, "raw"), "train-scores")
        model.params["offset"] = percentiles(model.trained, "raw", [1 - CONTAMINATION])[0]
    return model


def score(features: DataFrame, model: Model, name: str = "anomaly_score") -> DataFrame:
    """Adds the model's score; only the feature vector goes to Python."""
    return score_many(features, {name: model})


def score_many(features: DataFrame, models: dict[str, Model]) -> DataFrame:
    """Scores of several models, one column each."""
    spark = features.sparkSession
    out = features
    for name, model in models.items():
        if model.kind == "lof":
            out = _add_factor(out, model, name)
            continue
        shared = spark.sparkContext.broadcast((model.kind, model.arrays, model.params))
        out = out.withColumn(name, _scorer(shared)(vector(model.scaler)))
    return out


def _scorer(shared):
    @F.pandas_udf("double")
    def run(vectors: pd.Series) -> pd.Series:
        kind, arrays, params = shared.value
        points = np.stack(vectors.to_numpy()).astype(float) if len(vectors) else np.zeros((0, 1))
        if not len(points):
            return pd.Series([], dtype=float)
        if kind == "iforest":
            trees = _trees(arrays)
            depth = int(np.ceil(np.log2(max(params["sample_size"], 2))))
            raw = 2.0 ** (-kernels.mean_path(points, trees, depth) / kernels.average_path(params["sample_size"]))
        else:
            raw = -kernels.fourier_map(points, arrays["weights"], arrays["phase"]) @ arrays["normal"]
        return pd.Series(raw - params["offset"])

    return run


def _trees(arrays: dict[str, np.ndarray]) -> list[dict]:
    """Node rows, ordered by (tree, node), as one set of arrays per tree."""
    starts = np.searchsorted(arrays["tree"], np.unique(arrays["tree"]))
    ends = [*starts[1:], len(arrays["tree"])]
    trees = []
    for a, b in zip(starts, ends):
        tree = {n: arrays[n][a:b] for n in ("feature", "threshold", "left", "right", "length")}
        leaf, own = tree["feature"] < 0, np.arange(b - a)
        tree["feature"] = np.where(leaf, 0, tree["feature"])
        tree["left"], tree["right"] = (np.where(leaf, own, tree[side]) for side in ("left", "right"))
        trees.append(tree)
    return trees


# --- isolation forest ----------------------------------------------------------


def _fit_iforest(features: DataFrame, scaler: Scaler, trees: int = 200, sample_size: int = 256, seed: int = SEED):
    """Every tree draws its own sample by a hash of (tree, session): rows below a threshold go to
    the tree's task, which keeps the ``sample_size`` with the lowest hash and grows the tree.
    Only nodes reach the driver, ``trees`` x 2 x ``sample_size`` at most.
    """
    n = features.count()
    size = min(sample_size, n)
    # six to seven deviations above the sample size, so no tree gets less than its sample
    share = min(1.0, (sample_size + 8 * np.sqrt(sample_size)) / n)
    cut = min(int(-(2**63) + share * 2**64), 2**63 - 1)
    drawn = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.struct(t.alias("tree"), F.xxhash64(F.lit(seed), t, *SESSION).alias("hash")))
    chosen = F.filter(drawn, lambda d: d["hash"] <= F.lit(cut))
    picked = features.select(F.explode(chosen).alias("d"), vector(scaler).alias("v")).select("d.tree", "d.hash", "v")

    def grow(batch):
        batch = batch.sort_values("hash", kind="stable").head(size)
        tree = int(batch["tree"].iloc[0])
        rows = sorted(kernels.grow_tree(np.stack(batch["v"].to_numpy()), np.random.default_rng([seed, tree])))
        frame = pd.DataFrame(rows, columns=["node", "feature", "threshold", "left", "right", "length"])
        frame.insert(0, "tree", tree)
        return frame

    schema = "tree long, node long, feature long, threshold double, left long, right long, length double"
    nodes = picked.groupBy("tree").applyInPandas(grow, schema).toPandas().sort_values(["tree", "node"])
    return {c: nodes[c].to_numpy() for c in nodes.columns if c != "node"}, {"sample_size": size, "trees": trees}


# --- one-class SVM --------------------------------------------------------------


def _fit_ocsvm(
    features: DataFrame, scaler: Scaler, nu: float = CONTAMINATION, dimensions: int = 256, rounds: int = 15, seed: int = SEED
):
    """Radial kernel by random Fourier features, then the one-class dual by
    conditional gradient: the best point of the feasible set in each round is the
    mean of the ``nu`` share of rows with the lowest projection, which one pass over
    the rows finds, so there are ``rounds`` + 1 passes at most."""
    rows = stage(features.select(vector(scaler).alias("v")), "vectors")
    varying = feature_stats(features).where("low < high").count()
    gamma = 1.0 / max(varying, 1)  # 1 / (features x variance of the scaled values)
    rng = np.random.default_rng(seed)
    weights = rng.normal(0.0, np.sqrt(2 * gamma), (len(NUMERIC_FEATURES), dimensions))
    phase = rng.uniform(0, 2 * np.pi, dimensions)
    normal = _lowest_mean(rows, weights, phase, np.zeros(dimensions), 1.0)
    for _ in range(rounds):
        step = _lowest_mean(rows, weights, phase, normal, nu) - normal
        gap, length = -float(normal @ step), float(step @ step)
        if gap <= 1e-4 * float(normal @ normal) or length == 0:
            break
        normal = normal + min(gap / length, 1.0) * step  # exact line search
    return {"weights": weights, "phase": phase, "normal": normal}, {"gamma": gamma, "nu": nu}


BINS = 1024  # of projections


def _lowest_mean(rows: DataFrame, weights, phase, normal, share: float) -> np.ndarray:
    """Mean of the mapped rows over the ``share`` of rows with the lowest projection on ``normal``.

    A mapped row is no longer than the root of two, which bounds the projections; the bound
    is cut into bins, and every task sends the count and the sum of its rows in each bin.
    The bin in which the share ends counts in part, with its mean.
    """
    reach = float(np.sqrt(2 * (normal @ normal))) or 1.0
    shared = rows.sparkSession.sparkContext.broadcast((weights, phase, normal))

    def partial(batches):
        weights, phase, normal = shared.value
        counts, sums = np.zeros(BINS), np.zeros((BINS, len(phase)))
        for batch in batches:
            if not batch.num_rows:
                continue
            # all rows have as many values
            vectors = batch.column("v").flatten().to_numpy().reshape(batch.num_rows, -1)
            for start in range(0, len(vectors), 512):  # so many stay in the processor's cache
                mapped = kernels.fourier_map(vectors[start : start + 512], weights, phase)
                kernels.add_to_bins(mapped, mapped @ normal, reach, counts, sums)
        held = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict(
            {"bin": held, "n": counts[held], "x": pa.array(list(sums[held]), pa.list_(pa.float64()))}
        )

    def add(parts):
        return pd.DataFrame({"bin": parts["bin"].iloc[:1], "n": [parts["n"].sum()], "x": [np.sum(np.stack(parts["x"].to_numpy()), axis=0)]})

    schema = "bin long, n double, x array<double>"
    # one row per bin
    bins = rows.mapInArrow(partial, schema).groupBy("bin").applyInPandas(add, schema).toPandas().sort_values("bin")
    return kernels.mean_of_lowest(bins["n"].to_numpy(), np.stack(bins["x"].to_numpy()), share)


# --- local outlier factor ---------------------------------------------------------


BLOCK = 256  # points of a leaf, which are compared with as many others at a time
LEAVES = 65_536  # of the training rows, about; with more rows leaves hold more
CELLS = 2048  # of the tree that the driver grows, at most; a cell holds some leaves
PART = 65_536  # rows of a cell that a task cuts into leaves
GROUP = 256  # leaves whose points meet the reference together, at most
LEAF = ["cell", "part", "leaf"]


def _fit_lof(features: DataFrame, scaler: Scaler, neighbours: int = 20, seed: int = SEED):
    """Neighbours, densities and factors of all rows, as tables joined by point.

    Equal rows are one point with a number of copies.  The table keeps the ``factor`` that a
    row equal to the point is scored with: then the point itself is its nearest neighbour, at
    distance 0, in the place of the last one that it has among the others.
    """
    points = features.select(vector(scaler).alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("copies"))
    points = stage(points.withColumn("point", F.monotonically_increasing_id()), "points")
    total, different = points.agg(F.sum("copies"), F.count(F.lit(1))).first()
    k = max(1, min(neighbours, total - 1))
    picked = lowest_hash(points.select("v"), ["v"], 16 * _cells(different), seed)
    sample = np.array([r[0] for r in picked.collect()], dtype=float).reshape(-1, len(NUMERIC_FEATURES))
    index = _index(points, sample)
    near = _neighbours(points, points, index, k, own=True)
    # times among the others, and times when the point is one of its neighbours
    again = F.col("times") - F.col("last").cast("long") + (F.col("point") == F.col("neighbour")).cast("long")
    alone = points.where("copies = 1").selectExpr("point", "point AS neighbour", "0D AS distance", "0L AS times", "1L AS again")
    met = near.select("point", "neighbour", "distance", "times", again.alias("again")).unionByName(alone)
    known = points.join(near.where("last").select("point", "k_distance"), "point", "left")
    known = known.fillna({"k_distance": 0.0})  # a single row has no neighbours
    reach = _of_neighbours(met, known.select("point", "k_distance"), F.greatest("distance", "k_distance"), k)
    density = (1 / (F.col("others") + 1e-10)).alias("density")
    known = stage(known.join(reach, "point").select("point", "v", "copies", "k_distance", density, F.col("again").alias("reach")), "densities")
    dense = _of_neighbours(met, known.select("point", "density"), F.col("density"), k)
    factor = F.col("again") * (F.col("reach") + 1e-10)
    own = F.col("others") / F.col("density") if total > 1 else F.lit(1.0)
    known = stage(known.join(dense, "point").select("point", "v", "copies", "k_distance", "density", factor.alias("factor"), own.alias("own")), "factors")
    offset = percentiles(known.select("own", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))), "own", [1 - CONTAMINATION])[0]
    return index, {"neighbours": k, "train_offset": offset}, known.drop("own")


def _of_neighbours(met: DataFrame, of: DataFrame, value, k: int) -> DataFrame:
    """``point, others, again``: the mean of ``value`` over the ``k`` neighbours of each point among
    the others, and over those that it has with itself."""
    joined = met.join(of.withColumnRenamed("point", "neighbour"), "neighbour")
    return joined.groupBy("point").agg(*[(F.sum(value * F.col(n)) / k).alias(name) for n, name in (("times", "others"), ("again", "again"))])


def _add_factor(rows: DataFrame, model: Model, name: str) -> DataFrame:
    """Adds the local outlier factor among the rows the model was trained on.

    A row equal to one of them has the factor that is kept with it; only the others are
    compared with the training rows.  Keys are told apart by a hash first, which sorts fast.
    """
    columns = rows.columns
    hashed = F.xxhash64("_v").alias("_h")
    kept = model.table.select(F.col("v").alias("_v"), F.col("factor").alias("_factor")).select("*", hashed)
    rows = rows.withColumn("_v", vector(model.scaler)).select("*", hashed)
    rows = stage(rows.join(kept, ["_h", "_v"], "left"), "rows")
    factor = F.col("_factor")
    unseen = rows.where(factor.isNull()).select("_h", "_v").distinct()
    if not unseen.isEmpty():
        rows = rows.join(_unseen_factors(unseen, model), ["_h", "_v"], "left")
        factor = F.coalesce("_factor", "_new")
    return rows.select(*columns, (factor - F.lit(model.params["offset"])).alias(name))


def _unseen_factors(unseen: DataFrame, model: Model) -> DataFrame:
    """Adds ``_new``, the factor of vectors that the model was not trained on."""
    k = model.params["neighbours"]
    points = stage(unseen.withColumn("point", F.monotonically_increasing_id()).withColumnRenamed("_v", "v"), "points")
    near = _neighbours(points, model.table, model.arrays, k).select("point", "neighbour", "distance", "times")
    known = model.table.select(F.col("point").alias("neighbour"), "k_distance", "density")
    means = near.join(known, "neighbour").groupBy("point").agg(
        (F.sum(F.col("density") * F.col("times")) / k).alias("density"),
        (F.sum(F.greatest("distance", "k_distance") * F.col("times")) / k).alias("reach"),
    )
    factor = F.col("density") * (F.col("reach") + 1e-10)
    return stage(points.join(means, "point").select("_h", F.col("v").alias("_v"), factor.alias("_new")), "scores")


def _cells(rows: int) -> int:
    return int(np.clip(-(-rows // (8 * BLOCK)), 1, CELLS))


def _index(points: DataFrame, sample: np.ndarray) -> dict[str, np.ndarray]:
    """The planes of a tree of cells that hold as many rows of the sample each, about."""
    return kernels.grow_cells(sample, _cells(points.count()))


def _placed(points: DataFrame, shared) -> DataFrame:
    """``point, v, copies`` with the cell."""

    def place(batches):
        for batch in batches:
            cell = kernels.cell_of(kernels.matrix(batch.column("v")), shared.value)
            yield batch.append_column("cell", pa.array(cell, pa.int32()))

    return points.select("point", "v", "copies").mapInArrow(place, "point long, v array<double>, copies long, cell int")


def _blocks(points: DataFrame, shared, size: int) -> DataFrame:
    """``cell, part, leaf, low, high, n, rows, points``: the points of a leaf, ``size`` of them at most,
    packed, the corners of the box that they lie in, their number and that with copies."""
    placed = stage(_placed(points, shared), "cells")
    parts = placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / PART).alias("_parts"))  # CELLS rows at most
    part = F.pmod(F.xxhash64("point"), F.col("_parts")).cast("int").alias("part")
    dealt = placed.join(F.broadcast(parts), "cell").select("cell", part, "point", "copies", "v")

    def pack(table):
        cell, part = table["cell"][0].as_py(), table["part"][0].as_py()
        ids, copies, vectors = table["point"].to_numpy(), table["copies"].to_numpy(), kernels.matrix(table["v"].combine_chunks())
        rows = []
        for leaf, at in enumerate(kernels.leaves(vectors, size)):
            low, high = vectors[at].min(axis=0).tobytes(), vectors[at].max(axis=0).tobytes()
            rows.append((cell, part, leaf, low, high, len(at), int(copies[at].sum()), kernels.pack(ids[at], copies[at], vectors[at])))
        return pa.Table.from_pylist([dict(zip(leaf_schema.names, row)) for row in rows], leaf_schema)

    leaf_schema = pa.schema([
        *[pa.field(c, pa.int32()) for c in LEAF], ("low", pa.binary()), ("high", pa.binary()), ("n", pa.int64()), ("rows", pa.int64()), ("points", pa.binary()),
    ])
    schema = "cell int, part int, leaf int, low binary, high binary, n long, rows long, points binary"
    return stage(dealt.groupBy("cell", "part").applyInArrow(pack, schema), "blocks")


def _boxes(blocks: DataFrame) -> dict[str, dict[str, np.ndarray]]:
    """The boxes of all leaves and of the cells, some ``LEAVES`` and at most ``CELLS``."""
    found = blocks.select(*LEAF, "low", "high", "rows").toPandas().sort_values(LEAF)
    low, high = (np.array([np.frombuffer(x) for x in found[c]]) for c in ("low", "high"))
    cell, rows = found["cell"].to_numpy(), found["rows"].to_numpy()
    start = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
    cells = {"low": np.minimum.reduceat(low, start), "high": np.maximum.reduceat(high, start), "rows": np.add.reduceat(rows, start)}
    return {
        "cells": {**cells, "start": start, "end": np.r_[start[1:], len(cell)]},
        "leaves": {"low": low, "high": high, **{c: found[c].to_numpy() for c in LEAF}},
    }


def _grouped(blocks: DataFrame) -> tuple[DataFrame, int]:
    """Adds ``own``, the group of a leaf: leaves of neighbouring cells, ``GROUP`` of them at most,
    and no more than leave two groups for every core.  Beside it the number of groups."""
    spark = blocks.sparkSession
    parts = blocks.groupBy("cell", "part").agg(F.count(F.lit(1)).alias("n")).toPandas().sort_values(["cell", "part"])  # a row per part of a cell
    total = int(parts["n"].sum())
    size = int(np.clip(-(-total // (2 * spark.sparkContext.defaultParallelism)), 1, GROUP))
    starts = [(int(c), int(p), int(s)) for c, p, s in zip(parts["cell"], parts["part"], parts["n"].cumsum() - parts["n"])]
    first = spark.createDataFrame(starts, "cell int, part int, _first long")
    grouped = blocks.join(F.broadcast(first), ["cell", "part"])
    return grouped.withColumn("own", F.floor((F.col("_first") + F.col("leaf")) / size)).drop("_first"), -(-total // size)


def _neighbours(points: DataFrame, reference: DataFrame, index: dict[str, np.ndarray], k: int, own: bool = False, compared=None) -> DataFrame:
    """``point, neighbour, distance, times, last, k_distance``: the ``k`` nearest of ``reference``, where
    one with several copies is taken several ``times``; which is the last of them, and how far it is.

    Points and reference lie in cells between planes, cells are cut into leaves, and every leaf has
    the box that its points lie in.  A leaf of points first meets the reference of its own cell, the
    nearest boxes first, which bounds how far its neighbours are; then it meets, by equality of their
    numbers, the leaves whose boxes the bounds reach, the nearest first.  Leaves of neighbouring
    cells meet the reference together, as one group, so a leaf of the reference is sent once to a
    group and not to every leaf that needs it.  A task holds a group and, of the reference, a part
    of a cell.  ``compared`` is an accumulator of the pairs of points that were compared.
    """
    spark = points.sparkSession
    size = max(BLOCK, 2 * reference.count() // LEAVES)
    shared = spark.sparkContext.broadcast(index)
    theirs = _blocks(reference.select("point", "v", "copies"), shared, size)
    ours, groups_made = _grouped(theirs if own else _blocks(points.select("point", "v", F.lit(1).cast("long").alias("copies")), shared, size))
    boxes = spark.sparkContext.broadcast(_boxes(theirs))
    columns = ["own", "near", *LEAF, "low", "high", "n", "points", "reach"]

    def meeting(pairs: DataFrame, heads: DataFrame, on: list[str]) -> DataFrame:
        met = pairs.select("own", "near", *on).join(theirs, on)
        rows = met.withColumn("reach", F.lit(None).cast("binary")).select(columns).unionByName(heads.withColumn("near", F.lit(-1.0)).select(columns))
        # a group is much work on few bytes, by which adaptive execution would join the tasks of several
        return rows.repartition(max(1, 2 * groups_made), "own").sortWithinPartitions("own", "near", *LEAF)

    def opened(row):
        low, high = np.frombuffer(row["low"]), np.frombuffer(row["high"])
        return {**row, "low": low, "high": high, "open": functools.cache(lambda: kernels.unpack(row["points"], row["n"]))}

    def groups(batches):
        """The leaves of a group, then what they meet."""
        rows = (opened({c: batch.column(c)[i].as_py() for c in columns}) for batch in batches for i in range(batch.num_rows))
        for owner, members in itertools.groupby(rows, lambda row: row["own"]):
            group, members = [], iter(members)
            for row in members:
                if row["near"] >= 0:
                    members = itertools.chain([row], members)
                    break
                ids, _, vectors = row["open"]()
                bound = np.frombuffer(row["reach"]) if row["reach"] else np.full(len(ids), np.inf)
                best = np.full((len(ids), k), np.inf), np.full((len(ids), k), -1), np.zeros((len(ids), k), int)
                # points of a query are not rows of the reference, whatever their number
                apart = ids if own else np.full(len(ids), -1)
                more = {"ids": ids, "apart": apart, "vectors": vectors, "best": best, "bound": bound, "limit": bound * (1 + 1e-9) + 1e-9}
                group.append({**row, **more})
            yield owner, group, members

    def meet(mine, other):
        rows = np.flatnonzero(kernels.gap(mine["vectors"], other["low"], other["high"]) <= mine["limit"])
        if not len(rows):
            return
        their_ids, copies, vectors = other["open"]()
        found = kernels.nearer(mine["best"], mine["limit"], rows, mine["vectors"], mine["apart"], vectors, their_ids, copies, k)
        reach = np.minimum(kernels.reach_of(tuple(x[found] for x in mine["best"]), k), mine["bound"][found])
        mine["limit"][found] = reach * (1 + 1e-9) + 1e-9
        if compared is not None:
            compared.add(len(rows) * len(their_ids))

    def bounds(batches):
        """How far the neighbours of a group's points are, and the leaves within that."""
        cells, leaves = boxes.value["cells"], boxes.value["leaves"]
        for owner, group, members in groups(batches):
            of_cell = {}
            for mine in group:
                of_cell.setdefault(mine["cell"], []).append(mine)
            for (cell, _), part in itertools.groupby(members, lambda row: (row["cell"], row["part"])):
                part = list(part)
                lows, highs = (np.array([other[c] for other in part]) for c in ("low", "high"))
                for mine in of_cell[cell]:
                    middle = np.abs((lows + highs - mine["low"] - mine["high"])).sum(axis=1)
                    for at in np.lexsort((middle, kernels.gap_of_boxes(mine["low"], mine["high"], lows, highs))):
                        meet(mine, part[at])
            for mine in group:
                reach = kernels.reach_of(mine["best"], k)
                open_ended = np.isinf(reach)
                reach[open_ended] = kernels.box_reach(mine["vectors"][open_ended], cells["low"], cells["high"], cells["rows"], k)
                held, near = kernels.boxes_within(mine["vectors"], reach, cells, leaves)
                needed = [{**{c: int(leaves[c][at]) for c in LEAF}, "near": least} for at, least in zip(held, near)]
                row = {"own": owner, **{c: mine[c] for c in LEAF}, "reach": reach.tobytes(), "needed": needed}
                yield pa.RecordBatch.from_pylist([row], needed_schema)

    def found(batches):
        """The neighbours of a group's points among the leaves that it meets."""
        for _, group, members in groups(batches):
            lows, highs = (np.array([mine[c] for mine in group]) for c in ("low", "high"))
            limits = np.array([mine["limit"].max() for mine in group])
            for other in members:
                for at in np.flatnonzero(kernels.gap_of_boxes(other["low"], other["high"], lows, highs) <= limits):
                    meet(group[at], other)
                    limits[at] = group[at]["limit"].max()
            for mine in group:
                yield pa.RecordBatch.from_pydict(kernels.neighbour_rows(mine["ids"], mine["best"], k))

    leaf = [pa.field(c, pa.int32()) for c in LEAF]
    needed_schema = pa.schema([("own", pa.int64()), *leaf, ("reach", pa.binary()), ("needed", pa.list_(pa.struct([*leaf, ("near", pa.float64())])))])
    # a row is a whole leaf
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, 32)
    try:
        here = ours.select("own", "cell").distinct().withColumn("near", F.lit(0.0))
        heads = ours.withColumn("reach", F.lit(None).cast("binary"))
        schema = "own long, cell int, part int, leaf int, reach binary, needed array<struct<cell:int,part:int,leaf:int,near:double>>"
        needed = stage(meeting(here, heads, ["cell"]).mapInArrow(bounds, schema), "needed")
        pairs = needed.select("own", F.inline("needed")).groupBy("own", *LEAF).agg(F.min("near").alias("near"))
        heads = ours.join(needed.select(*LEAF, "reach"), LEAF)
        schema = "point long, neighbour long, distance double, times long, last boolean, k_distance double"
        return stage(meeting(pairs, heads, LEAF).mapInArrow(found, schema), "neighbours")
    finally:
        spark.conf.set(key, before)


# --- storage ------------------------------------------------------------------------


def save(spark: SparkSession, model: Model, path: str) -> None:
    """Arrays as one Parquet table each, and one metadata row."""
    for name, values in model.arrays.items():
        flat = values.reshape(len(values), -1)
        rows = [(i, [float(x) for x in row]) for i, row in enumerate(flat)]
        spark.createDataFrame(rows, "row long, x array<double>").coalesce(1).write.mode("overwrite").parquet(
            f"{path}/arrays/{name}"
        )
    if model.table is not None:
        model.table.write.mode("overwrite").parquet(f"{path}/table")
    info = {
        "kind": model.kind,
        "scaler": {"mean": model.scaler.mean, "scale": model.scaler.scale},
        "params": model.params,
        "arrays": {n: [list(a.shape), str(a.dtype)] for n, a in model.arrays.items()},
        "metadata": model.metadata,
    }
    spark.createDataFrame([(json.dumps(info),)], "info string").coalesce(1).write.mode("overwrite").parquet(
        f"{path}/metadata"
    )


def load(spark: SparkSession, path: str) -> Model:
    info = json.loads(spark.read.parquet(f"{path}/metadata").first()[0])
    arrays = {}
    for name, (shape, kind) in info["arrays"].items():
        rows = spark.read.parquet(f"{path}/arrays/{name}").orderBy("row").collect()
        arrays[name] = np.array([r["x"] for r in rows]).reshape(shape).astype(kind)
    table = spark.read.schema(TABLE).parquet(f"{path}/table") if info["kind"] == "lof" else None
    return Model(info["kind"], Scaler(**info["scaler"]), arrays, info["params"], info["metadata"], table)
