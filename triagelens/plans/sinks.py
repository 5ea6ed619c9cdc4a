"""Result sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triagelens.functions.wording import FEATURE_VERSION


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON object per line; null values are written, NaN as null."""
    doubles = {n for n, t in df.dtypes if t == "double"}
    clean = df.select(*[F.nanvl(c, F.lit(None)).alias(c) if c in doubles else F.col(c) for c in df.columns])
    clean.write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_comparison(summaries: DataFrame, path: str, log_type: str, logs_path: str) -> None:
    """One JSON object that describes a comparison of models, a key per model."""
    keys = [c for c in summaries.columns if c not in ("model_type", "threshold_percentile")]
    by_model = F.map_from_entries(F.collect_list(F.struct("model_type", F.struct(*keys))))
    # one row per model
    whole = summaries.agg(by_model.alias("model_summaries"), F.max("threshold_percentile").alias("threshold_percentile"))
    described = whole.select(
        F.lit(log_type).alias("log_type"),
        F.lit(logs_path).alias("logs_path"),
        F.lit(FEATURE_VERSION).alias("feature_version"),
        "threshold_percentile",
        "model_summaries",
        F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("compared_at_utc"),
    )
    described.coalesce(1).write.mode("overwrite").json(path)
