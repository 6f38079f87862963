"""Additive seasonal decomposition per series.

trend    centred moving average over ``period`` rows (even period: 2x``period``
         MA with half weights at both ends); null for half a period at each end.
seasonal mean of (obs - trend) by position modulo ``period``, centred so the
         ``period`` means sum to zero.
resid    obs - trend - seasonal.

Plan: one window pass for the trend (partitioned by the keys), one aggregate
by (keys, phase) whose output is ``#series x period`` rows, joined back on
(keys, phase).  The input must be gap-free (interpolate first).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def seasonal_decompose(df: DataFrame, keys: list[str], t: str, v: str, period: int = 365) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(t)
    h = period // 2
    x = F.col(v)
    # Centred sums as differences of running sums: O(n) per series, where a sliding
    # frame of ``period`` rows would be re-aggregated for every row.
    running = w.rowsBetween(Window.unboundedPreceding, 0)
    base = df.withColumns({"_s": F.sum(x).over(running), "_c": F.count(x).over(running),
                           "_rn": F.row_number().over(w)})
    s_hi, c_hi = F.lead("_s", h).over(w), F.lead("_c", h).over(w)
    start_ok = F.lag("_rn", h).over(w).isNotNull()
    s_lo = F.coalesce(F.lag("_s", h + 1).over(w), F.lit(0.0))
    c_lo = F.coalesce(F.lag("_c", h + 1).over(w), F.lit(0))
    window_sum = s_hi - s_lo
    full = start_ok & ((c_hi - c_lo) == 2 * h + 1)
    if period % 2:
        trend = window_sum / F.lit(float(period))
    else:
        ends = F.lag(x, h).over(w) + F.lead(x, h).over(w)
        trend = (window_sum - F.lit(0.5) * ends) / F.lit(float(period))
    base = base.withColumns({"_phase": F.pmod(F.col("_rn") - 1, F.lit(period)), "trend": F.when(full, trend)})
    base = base.withColumn("_detrended", x - F.col("trend"))
    phase_means = base.groupBy(*keys, "_phase").agg(F.avg("_detrended").alias("_pm"))
    centred = phase_means.withColumn(
        "_seasonal", F.col("_pm") - F.avg("_pm").over(Window.partitionBy(*keys)))
    out = base.join(centred.select(*keys, "_phase", "_seasonal"), on=keys + ["_phase"], how="left")
    return (out.withColumn("seasonal", F.col("_seasonal"))
            .withColumn("resid", x - F.col("trend") - F.col("seasonal"))
            .drop("_phase", "_detrended", "_seasonal", "_s", "_c", "_rn"))
