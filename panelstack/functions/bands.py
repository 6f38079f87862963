"""Threshold bands on an index scale (US AQI style) and clipping.

Two band functions exist on purpose:

* ``aqi_band`` is the *label* used for reporting: ``<=50`` Good, ``<=100``
  Moderate, ... everything above 300 is Hazardous (also 600).  Null stays null
  unless ``null_as_last`` is set, which reproduces "every comparison false"
  behaviour of NaN in plain Python comparisons.
* ``aqi_class`` is the *training label*: right-closed intervals (0,50], (50,100],
  ..., (300,500] coded 0..5; 0, negatives, values above 500 and null -> null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values (must match the index definition): category labels, bin edges
# and display colours, in band order.
BAND_LABELS = [
    "Good",
    "Moderate",
    "Unhealthy for Sensitive Groups",
    "Unhealthy",
    "Very Unhealthy",
    "Hazardous",
]
BAND_EDGES = [0, 50, 100, 150, 200, 300, 500]
BAND_COLORS = ["#00E400", "#FFFF00", "#FF7E00", "#FF0000", "#8F3F97", "#7E0023"]


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(c) -> Column:
    """NaN -> NULL; Spark aggregates propagate NaN where pandas skips it."""
    c = _col(c)
    return F.when(~F.isnan(c), c)


def aqi_band_code(c, null_as_last: bool = False) -> Column:
    """0..5 band code for the reporting label (upper edges inclusive)."""
    c = nan_to_null(_col(c))
    expr = F.when(c <= BAND_EDGES[1], F.lit(0))
    for code, hi in enumerate(BAND_EDGES[2:-1], start=1):
        expr = expr.when(c <= hi, F.lit(code))
    expr = expr.when(c.isNotNull(), F.lit(len(BAND_LABELS) - 1))
    if null_as_last:
        expr = expr.otherwise(F.lit(len(BAND_LABELS) - 1))
    return expr


def band_label_of_code(code: Column) -> Column:
    """0..5 -> label; anything else -> null (a CASE chain, evaluated inside generated code)."""
    expr = F.when(code == 0, F.lit(BAND_LABELS[0]))
    for i, lab in enumerate(BAND_LABELS[1:], start=1):
        expr = expr.when(code == i, F.lit(lab))
    return expr


def aqi_band(c, null_as_last: bool = False) -> Column:
    """Reporting label of a value (upper band edges inclusive)."""
    return band_label_of_code(aqi_band_code(c, null_as_last))


def aqi_class(c) -> Column:
    """Right-closed bins (0,50], (50,100], ..., (300,500] -> 0..5, else null."""
    c = nan_to_null(_col(c))
    expr = None
    for code, (lo, hi) in enumerate(zip(BAND_EDGES[:-1], BAND_EDGES[1:])):
        cond = (c > lo) & (c <= hi)
        expr = F.when(cond, F.lit(code)) if expr is None else expr.when(cond, F.lit(code))
    return expr


def clip(c, lo: float | None, hi: float | None) -> Column:
    """Clip to [lo, hi]; NaN and null stay null.

    ``greatest``/``least`` skip nulls and rank NaN highest, so the guard is
    needed to keep missing values missing.
    """
    c = nan_to_null(_col(c))
    out = c
    if lo is not None:
        out = F.greatest(out, F.lit(float(lo)))
    if hi is not None:
        out = F.least(out, F.lit(float(hi)))
    return F.when(c.isNotNull(), out)


def band_dim(spark: SparkSession) -> DataFrame:
    """The six-row band dimension (code, label, lo, hi, color); fixed size."""
    rows = [
        (i, BAND_LABELS[i], float(BAND_EDGES[i]), float(BAND_EDGES[i + 1]), BAND_COLORS[i])
        for i in range(len(BAND_LABELS))
    ]
    return spark.createDataFrame(rows, "code int, label string, lo double, hi double, color string")
