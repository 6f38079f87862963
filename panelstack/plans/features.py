"""The feature pipeline: raw daily panel -> model-ready, leakage-free features.

grid (C1) -> time interpolation (C2) -> lags, shifted rolling stats, differences
and the next-day target in one window projection (D1-D4, D2) -> calendar
encodings (G1-G3) -> class label (B6) -> drop warm-up/last rows (B9) -> per-series
time split (D10) -> winsorizing fences fitted on train (E16) -> robust scaling
fitted on train (E17).

Plan shape: the window columns share one ``partitionBy(keys).orderBy(t)`` spec,
so one exchange on the keys feeds every window; the pre-fit panel is
written as parquet into the shared checkpoint folder and read back, so the
fit and the final projection scan it instead of recomputing the lineage (and a
lost executor only re-reads those files).
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelstack.functions.bands import aqi_class
from panelstack.functions.calendar import cyclic_features, flag_features
from panelstack.operators.clean import drop_incomplete, fill_values
from panelstack.operators.grid import interpolate, to_daily_grid
from panelstack.operators.quantiles import order_statistics
from panelstack.operators.stats import Fences, RobustScaler, fences_of, scaler_of
from panelstack.operators.windows import time_split, window_features
from panelstack.session import materialize

# Feature recipe of the daily model.
LAGS = (1, 2, 3, 7, 14)
WINDOWS = (3, 7, 14, 30)
FUNCS = ("mean", "std", "max", "min")
DIFFS = (1, 7)
CYCLIC = ["month_sin", "month_cos", "weekday_sin", "weekday_cos", "day_of_year_sin", "day_of_year_cos"]
FLAGS = ["is_weekend", "is_dry_season"]
TARGET = "target_reg_tomorrow"
TARGET_CLASS = "target_class_tomorrow"


def window_feature_names() -> list[str]:
    return ([f"lag_{k}" for k in LAGS] + [f"rolling_{f}_{w}" for w in WINDOWS for f in FUNCS]
            + [f"diff_{k}" for k in DIFFS])


def feature_names(measures: list[str]) -> list[str]:
    return list(measures) + window_feature_names() + CYCLIC + FLAGS


def scaled_names(measures: list[str]) -> list[str]:
    return list(measures) + window_feature_names()


@dataclass
class FeaturePipeline:
    keys: list[str]
    t: str
    value: str
    measures: list[str]
    fences: Fences | None = None
    scaler: RobustScaler | None = None

    @property
    def features(self) -> list[str]:
        return feature_names(self.measures)

    def frame(self, df: DataFrame) -> DataFrame:
        """Grid, interpolation, window and calendar features, target; one row a day, incomplete ones too."""
        keys, t, v = self.keys, self.t, self.value
        df = df.select(*keys, t, F.col(v).cast("double").alias(v), *[F.col(m).cast("double").alias(m) for m in self.measures])
        filled = interpolate(to_daily_grid(df, keys, t), keys, t, [v] + self.measures, method="time", edges="both")
        f = window_features(filled, keys, t, v, LAGS, WINDOWS, FUNCS, DIFFS, lead=1, target=TARGET)
        f = f.withColumns(cyclic_features(t) | flag_features(t))
        return f.withColumn(TARGET_CLASS, aqi_class(TARGET))

    def build(self, df: DataFrame) -> DataFrame:
        """Unfitted part of training: complete rows with a next-day target, and the time split."""
        keys, t = self.keys, self.t
        f = drop_incomplete(self.frame(df), self.features + [TARGET])
        return time_split(f, keys, t).select(*keys, t, "split", TARGET, TARGET_CLASS, *self.features)

    def fit_transform(self, df: DataFrame) -> DataFrame:
        panel = materialize(self.build(df), "feature_panel")
        scaled = scaled_names(self.measures)
        # One pass of order statistics serves the fences and, behind them, the scaler.
        stats = order_statistics(panel.where(F.col("split") == "train"), scaled, [0.25, 0.5, 0.75])
        self.fences = fences_of(stats, self.measures, k=3.0, floor=0.0)
        self.scaler = scaler_of(stats, scaled, self.fences)
        return self._apply(panel)

    def _apply(self, df: DataFrame) -> DataFrame:
        return self.scaler.transform(self.fences.transform(df))

    def transform(self, df: DataFrame) -> DataFrame:
        """Score path: every day of the input, with the fitted fences and scaler.

        Missing features take the training median, which is 0 after scaling, so no row is lost.
        """
        out = self.frame(df).select(*self.keys, self.t, TARGET, TARGET_CLASS, *self.features)
        return fill_values(self._apply(out), dict.fromkeys(scaled_names(self.measures), 0.0))

    def state(self) -> dict:
        """All that scoring needs, as plain JSON."""
        return {"keys": self.keys, "t": self.t, "value": self.value, "measures": self.measures, "features": self.features,
                "fences": {c: list(b) for c, b in self.fences.bounds.items()}, "scaler": {c: list(p) for c, p in self.scaler.params.items()}}

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame([(json.dumps(self.state()),)], "state string").coalesce(1).write.mode("overwrite").text(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> FeaturePipeline:
        s = json.loads(spark.read.text(path).first()[0])
        return FeaturePipeline(s["keys"], s["t"], s["value"], s["measures"], Fences({c: tuple(b) for c, b in s["fences"].items()}),
                               RobustScaler({c: tuple(p) for c, p in s["scaler"].items()}))
