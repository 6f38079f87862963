"""Derived panels used by the registered queries (Spark side)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelstack.operators.grid import interpolate, to_daily_grid
from panelstack.sources.fixtures import hourly_readings, p2_daily_panel
from panelstack.streaming.daily import daily_mean

K = ["series_id"]


def daily_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5 on the raw event readings: (series_id, day, value = round(mean, 2))."""
    return daily_mean(hourly_readings(spark, sf_dir), K, "ts", ["value"])


def p2_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P2 on a gap-free calendar grid, gaps filled by time interpolation (head/tail nearest)."""
    return interpolate(to_daily_grid(p2_daily_panel(spark, sf_dir), K, "date"), K, "date", ["value"])
