"""Model artefacts: fitted pipelines plus a metadata record (feature order, metrics, fit time)."""

from __future__ import annotations

import datetime as dt
import json

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession


def save_model(spark: SparkSession, model: PipelineModel, path: str, feature_cols: list[str],
               metrics: dict[str, float] | None = None, name: str = "model", features=None) -> None:
    """Model under ``path/model``, one JSON metadata row under ``path/metadata`` and, where given, the
    fitted feature pipeline (fences, scaler, feature order) under ``path/features``."""
    model.write().overwrite().save(f"{path}/model")
    if features is not None:
        features.save(spark, f"{path}/features")
    meta = {"name": name, "n_features": len(feature_cols), "feature_cols": feature_cols,
            "metrics": json.dumps(metrics or {}), "saved_at": dt.datetime.now(dt.timezone.utc).isoformat()}
    spark.createDataFrame([meta]).coalesce(1).write.mode("overwrite").json(f"{path}/metadata")


def load_model(spark: SparkSession, path: str) -> tuple[PipelineModel, list[str], DataFrame]:
    meta = spark.read.json(f"{path}/metadata")
    features = list(meta.select("feature_cols").first()[0])
    return PipelineModel.load(f"{path}/model"), features, meta
