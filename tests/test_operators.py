import numpy as np
import pytest
from pyspark.sql import functions as F

from panelstack.operators.grid import interpolate, to_daily_grid
from panelstack.operators.stats import describe, histogram, skew_std
from panelstack.operators.windows import rolling_features, time_series_folds, time_split, window_features


def _days(spark, values, days):
    rows = [("s", f"2024-01-{d:02d}", v) for d, v in zip(days, values)]
    return spark.createDataFrame(rows, "series_id string, d string, value double").select(
        "series_id", F.to_date("d").alias("date"), "value")


def _vals(df):
    return [None if r.value is None else round(r.value, 3) for r in df.orderBy("date").collect()]


def test_interpolation_variants(spark):
    df = _days(spark, [None, None, 1.0, None, 3.0, None], [1, 2, 3, 5, 9, 10])
    k = ["series_id"]
    assert _vals(interpolate(df, k, "date", ["value"], "time", "both")) == [1, 1, 1, 1.667, 3, 3]
    assert _vals(interpolate(df, k, "date", ["value"], "linear", "both")) == [1, 1, 1, 2, 3, 3]
    assert _vals(interpolate(df, k, "date", ["value"], "linear", "forward")) == [None, None, 1, 2, 3, 3]


def test_daily_grid_fills_calendar(spark):
    df = _days(spark, [1.0, 2.0], [1, 5])
    g = to_daily_grid(df, ["series_id"], "date")
    assert g.count() == 5
    assert _vals(interpolate(g, ["series_id"], "date", ["value"])) == [1, 1.25, 1.5, 1.75, 2]


def test_rolling_is_shifted_and_requires_full_window(spark):
    df = _days(spark, [1.0, None, 3.0, 4.0, 5.0], [1, 2, 3, 4, 5])
    r = rolling_features(df, ["series_id"], "date", "value", windows=(2,), funcs=("mean",)).orderBy("date").collect()
    assert [x.rolling_mean_2 for x in r] == [None, None, None, None, 3.5]


def test_quantiles_and_corrected_skew(spark):
    df = _days(spark, [1.0, 2.0, 2.0, 7.0, 9.0, 30.0], [1, 2, 3, 4, 5, 6])
    d = describe(df, ["series_id"], ["value"]).first()
    assert (d.q1, d.median, d.q3) == (2.0, 4.5, 8.5)
    s = skew_std(df, ["series_id"], ["value"]).first()
    assert s.skew == pytest.approx(2.01793, abs=1e-5)


def test_histogram_last_bin_closed(spark):
    df = _days(spark, [0.0, 1.0, 2.0, 3.0], [1, 2, 3, 4])
    h = histogram(df, ["series_id"], "value", bins=3).orderBy("bin").collect()
    assert [r["count"] for r in h] == [1, 1, 2]


def test_split_and_folds_sizes(spark):
    n = 1267
    df = spark.range(n).select(F.lit("s").alias("series_id"), F.date_add(F.lit("2020-01-01").cast("date"),
                                                                          F.col("id").cast("int")).alias("date"))
    s = time_split(df, ["series_id"], "date").groupBy("split").count().collect()
    assert {r.split: r["count"] for r in s} == {"train": 1013, "test": 254}
    train = time_split(df, ["series_id"], "date").where("split = 'train'").drop("split")
    f = time_series_folds(train, ["series_id"], "date", k=5)
    c = {(r.fold, r.role): r["count"] for r in f.groupBy("fold", "role").count().collect()}
    assert c[(0, "train")] == 173 and c[(0, "test")] == 168 and c[(4, "train")] == 173 + 4 * 168


def test_window_features_plan_one_exchange(spark):
    df = spark.range(100).select((F.col("id") % 3).cast("string").alias("series_id"),
                                 F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int")).alias("date"),
                                 F.rand(1).alias("value"))
    f = window_features(df, ["series_id"], "date", "value")
    plan = f._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert f.where(F.col("rolling_mean_30").isNotNull()).count() > 0
