"""Unions, equi/semi/anti joins, lookups and rank comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelstack.functions.bands import band_label_of_code


def append_and_tail(history: DataFrame, today: DataFrame, keys: list[str], t: str, n: int = 60) -> DataFrame:
    """Last ``n`` rows of each series' history plus the new rows (new rows replace same-day history)."""
    hist = history.join(today.select(*keys, t), on=keys + [t], how="left_anti")
    w = Window.partitionBy(*keys).orderBy(F.col(t).desc())
    tail = hist.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")
    return tail.unionByName(today, allowMissingColumns=True)


def union_rows(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def join_on_time(x: DataFrame, y: DataFrame, keys: list[str], t: str, how: str = "inner") -> DataFrame:
    """Column-concatenate two tables aligned on (keys, t); ``left_semi`` selects rows present in ``y``."""
    return x.join(y, on=keys + [t], how=how)


def lookup_band(df: DataFrame, code_col: str, label_col: str = "band_label", default: str = "Moderate") -> DataFrame:
    """code -> label as an expression (a 6-entry lookup needs no join); unknown codes -> ``default``."""
    return df.withColumn(label_col, F.coalesce(band_label_of_code(F.col(code_col)), F.lit(default)))


def rank_compare(a: DataFrame, b: DataFrame, item: str, score_a: str, score_b: str, top: int = 15) -> DataFrame:
    """Rank two feature scorings by absolute value, join by item, absolute rank difference, top ``top`` of ``a``.

    Both inputs are per-feature tables (one row per feature), bounded by the feature count.
    """
    ra = a.select(item, F.col(score_a).alias("score_a"),
                  F.row_number().over(Window.orderBy(F.abs(F.col(score_a)).desc(), F.col(item))).alias("rank_a"))
    rb = b.select(item, F.col(score_b).alias("score_b"),
                  F.row_number().over(Window.orderBy(F.abs(F.col(score_b)).desc(), F.col(item))).alias("rank_b"))
    j = ra.join(rb, on=item, how="inner").withColumn("rank_diff", F.abs(F.col("rank_a") - F.col("rank_b")))
    return j.where(F.col("rank_a") <= top)


def forecast_vs_actual(log: DataFrame, actual: DataFrame, keys: list[str], t: str, v: str,
                       pred_col: str = "predicted", target_date: str = "predicted_for_date") -> DataFrame:
    """Join each forecast to the value observed on the day it was made for; error = actual - predicted."""
    a = actual.select(*keys, F.col(t).alias(target_date), F.col(v).alias("actual"))
    j = log.join(a, on=keys + [target_date], how="inner")
    return j.withColumn("error", F.col("actual") - F.col(pred_col))


def stations_in_bounds(stations: DataFrame, lat_lo: float, lat_hi: float, lon_lo: float, lon_hi: float,
                       lat: str = "lat", lon: str = "lon") -> DataFrame:
    return stations.where(F.col(lat).between(lat_lo, lat_hi) & F.col(lon).between(lon_lo, lon_hi))
