import math

import pytest
from pyspark.sql import functions as F

from panelstack.functions import aqi_band, aqi_class, calendar_parts, clip

EDGE = [-1.0, 0.0, 50.0, 50.1, 100.0, 150.0, 200.0, 300.0, 500.0, 501.0, None, float("nan")]


def _col(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")


def test_band_labels_and_classes(spark):
    df = _col(spark, EDGE).select("i", aqi_band("v").alias("band"), aqi_class("v").alias("cls"),
                                  aqi_band("v", null_as_last=True).alias("band_nan_last")).orderBy("i")
    rows = df.collect()
    bands = [r.band for r in rows]
    assert bands[:10] == ["Good", "Good", "Good", "Moderate", "Moderate", "Unhealthy for Sensitive Groups",
                          "Unhealthy", "Very Unhealthy", "Hazardous", "Hazardous"]
    assert bands[10] is None and bands[11] is None
    assert rows[11].band_nan_last == "Hazardous"
    assert [r.cls for r in rows] == [None, None, 0, 1, 1, 2, 3, 4, 5, None, None, None]


def test_clip(spark):
    rows = _col(spark, [None, float("nan"), -3.0, 600.0, 42.0]).select(clip("v", 0, 500).alias("c")).collect()
    assert [r.c for r in rows] == [None, None, 0.0, 500.0, 42.0]


def test_leap_day_and_weekday(spark):
    df = spark.createDataFrame([("2024-12-31",), ("2024-01-01",)], "d string").select(F.to_date("d").alias("date"))
    rows = calendar_parts(df, "date").orderBy("date").collect()
    assert rows[1].day_of_year == 366
    assert rows[0].weekday == 0  # 2024-01-01 is a Monday


def test_cyclic_uses_365(spark):
    from panelstack.functions import cyclic_features
    df = spark.createDataFrame([("2024-12-31",)], "d string").select(F.to_date("d").alias("date"))
    r = df.withColumns(cyclic_features("date")).first()
    assert r.day_of_year_sin == pytest.approx(math.sin(2 * math.pi * 366 / 365))
