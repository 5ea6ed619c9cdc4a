"""Training, scoring with one or several models, and model comparison."""

from __future__ import annotations

from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triagelens.models import detectors
from triagelens.models.detectors import KINDS, Model
from triagelens.operators.features import NUMERIC_FEATURES
from triagelens.operators.ranking import min_max
from triagelens.operators.reports import score_summary
from triagelens.session import stage

DEFAULT_THRESHOLD = 99.0


def train(features: DataFrame, kind: str, log_type: str, logs_path: str = "", **options) -> Model:
    """Fit one model and describe the run."""
    model = detectors.fit(features, kind, **options)
    totals = features.agg(F.count(F.lit(1)).alias("n"), F.sum("event_count").alias("events")).first()
    model.metadata = {
        "log_type": log_type,
        "model_type": kind,
        "logs_path": logs_path,
        "trained_at_utc": datetime.now(timezone.utc).isoformat(),
        "feature_version": detectors.FEATURE_VERSION,
        "numeric_features": NUMERIC_FEATURES,
        "session_count": totals["n"],
        "event_count_total": totals["events"],
        "threshold_percentile_default": DEFAULT_THRESHOLD,
    }
    return model


def score_sessions(features: DataFrame, model: Model) -> DataFrame:
    return detectors.score(features, model, "anomaly_score")


def training_scores(features: DataFrame, model: Model) -> DataFrame:
    """The training rows' keys and ``anomaly_score``, which fitting has found but for the offset."""
    if model.trained is None:
        return stage(score_sessions(features, model), "scores")
    return model.trained.withColumn("anomaly_score", F.col("raw") - F.lit(model.params["offset"])).drop("raw")


def combine_scores(scored: DataFrame, kinds: list[str], ensemble: bool = True) -> DataFrame:
    """From the ``<kind>_score`` columns: each scaled to 0..1, their mean, and
    ``anomaly_score`` (the isolation forest's if there is one)."""
    out = min_max(scored, {f"{k}_score": f"{k}_score_norm" for k in kinds})
    main = "iforest" if "iforest" in kinds else kinds[0]
    out = out.withColumn("anomaly_score", F.col(f"{main}_score"))
    if ensemble:
        total = reduce(lambda a, b: a + b, [F.col(f"{k}_score_norm") for k in kinds])
        out = out.withColumn("ensemble_score", total / F.lit(float(len(kinds))))
    return out


def score_sessions_multi(features: DataFrame, models: dict[str, Model], ensemble: bool = True) -> DataFrame:
    """All models over one pass of the features, then combined."""
    scored = stage(detectors.score_many(features, {f"{k}_score": m for k, m in models.items()}), "scores")
    return combine_scores(scored, list(models), ensemble)


def compare_models(features: DataFrame, threshold_percentile: float = DEFAULT_THRESHOLD, kinds=KINDS) -> DataFrame:
    """Fit each model on the same features and summarize its scores."""
    rows = stage(features, "features")
    models = {f"{k}_score": detectors.fit(rows, k) for k in kinds}
    scored = stage(detectors.score_many(rows, models).select(*models), "scores")
    parts = [
        score_summary(scored, f"{k}_score", threshold_percentile).withColumn("model_type", F.lit(k)) for k in kinds
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)
