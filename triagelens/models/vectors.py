"""Feature vectors and their standardization."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triagelens.operators.features import NUMERIC_FEATURES


@dataclass
class Scaler:
    mean: list[float]
    scale: list[float]


def feature_stats(features: DataFrame) -> DataFrame:
    """Mean, population deviation, least and largest value of every feature: (feature, mean,
    deviation, low, high).

    A row per cell: hundreds of sums in one aggregate make code too long to be compiled.  Cells
    are told apart by their place, as numbers are grouped faster than names.
    """
    cells = F.posexplode(F.array(*[F.col(f).cast("double") for f in NUMERIC_FEATURES]))
    found = features.select(cells.alias("place", "x")).groupBy("place").agg(
        F.avg("x").alias("mean"), F.stddev_pop("x").alias("deviation"), F.min("x").alias("low"), F.max("x").alias("high")
    )
    names = F.array(*[F.lit(f) for f in NUMERIC_FEATURES])
    return found.select(F.get(names, F.col("place")).alias("feature"), "mean", "deviation", "low", "high")


def fit_scaler(features: DataFrame) -> Scaler:
    """Two numbers per feature; a constant feature keeps scale 1."""
    found = {row["feature"]: row for row in feature_stats(features).collect()}  # a row per feature
    if not found:
        raise ValueError("No training data was produced from the provided logs.")
    # to 9 digits, and no mean or deviation that is only rounding: the last digits
    # of a sum depend on the order of addition
    near = lambda x: float(f"{x:.9g}")
    mean = [near(found[f]["mean"]) for f in NUMERIC_FEATURES]
    spread = [near(found[f]["deviation"]) for f in NUMERIC_FEATURES]
    scale = [s if s > 1e-9 * max(1.0, abs(m)) else 1.0 for m, s in zip(mean, spread)]
    return Scaler([m if abs(m) > 1e-9 * s else 0.0 for m, s in zip(mean, scale)], scale)


def vector(scaler: Scaler | None = None) -> Column:
    """The features as one array of doubles, standardized if a scaler is given."""
    columns = [F.col(f).cast("double") for f in NUMERIC_FEATURES]
    if scaler:
        columns = [(c - F.lit(m)) / F.lit(s) for c, m, s in zip(columns, scaler.mean, scaler.scale)]
    return F.array(*columns)
