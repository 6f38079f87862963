"""Odd series, sinks that must not lose rows, quantiles at every size, saved pipelines."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelstack.operators import learn
from panelstack.operators.clean import fill_median, fit_medians
from panelstack.operators.decompose import seasonal_decompose
from panelstack.operators.forecast import ar1_multistep, ar1_walk_forward, ar_p_walk_forward, dickey_fuller
from panelstack.operators.grid import interpolate, to_daily_grid
from panelstack.operators.metrics import confusion_matrix
from panelstack.operators.quantiles import order_statistics
from panelstack.operators.stats import (
    banded_histogram, box_stats, corr_matrix, describe, fit_fences, fit_robust_scaler, histogram, kde, kpis, linear_trend, outlier_summary, skew_std, top_correlated,
)
from panelstack.operators.windows import last_n, time_series_folds, time_split, window_features
from panelstack.plans.features import FeaturePipeline
from panelstack.session import scratch_path
from panelstack.sources.writers import upsert_predictions
from tests.conftest import SF_SMALL

K, T = ["series_id"], "date"
DAY = dt.date(2024, 1, 1)


@pytest.fixture(scope="module")
def odd_panel(spark):
    """A normal series beside a constant, a short, an all-null and a one-row series."""
    r = random.Random(3)
    rows = [("normal", DAY + dt.timedelta(i), 50 + 10 * r.random() + i % 7, r.random()) for i in range(120)]
    rows += [("constant", DAY + dt.timedelta(i), 42.0, 1.0) for i in range(60)]
    rows += [("short", DAY + dt.timedelta(i), float(i), 2.0) for i in range(5)]
    rows += [("null", DAY + dt.timedelta(i), None, None) for i in range(40)]
    rows += [("one", DAY, 7.0, float("nan"))]
    return spark.createDataFrame(rows, "series_id string, date date, value double, other double").persist()


def test_every_series_operator_survives(odd_panel):
    split = time_split(odd_panel, K, T)
    plans = {
        "describe": describe(odd_panel, K, ["value", "other"]), "kpis": kpis(odd_panel, K, T, "value"), "box": box_stats(odd_panel, K, F.month(T), "value"),
        "histogram": histogram(odd_panel, K, "value"), "banded": banded_histogram(odd_panel, K, "value"), "kde": kde(odd_panel, K, "value", grid=10),
        "corr": corr_matrix(odd_panel, K, ["value", "other"]), "top": top_correlated(odd_panel, K, "value", ["other"]), "trend": linear_trend(odd_panel, K, "other", "value"),
        "skew": skew_std(odd_panel, K, ["value", "other"]), "outliers": outlier_summary(odd_panel, K, ["value"]), "decompose": seasonal_decompose(odd_panel, K, T, "value", 7),
        "ar1": ar1_walk_forward(split, K, T, "value"), "ar3": ar_p_walk_forward(split, K, T, "value", p=3), "steps": ar1_multistep(odd_panel, K, T, "value"),
        "df": dickey_fuller(odd_panel, K, T, "value"), "folds": time_series_folds(odd_panel, K, T), "tail": last_n(odd_panel, K, T, 3),
        "windows": window_features(odd_panel, K, T, "value", (1, 2), (3,), ("mean", "std"), (1,), lead=1, target="y"),
        "grid": interpolate(to_daily_grid(odd_panel, K, T), K, T, ["value", "other"]),
    }
    for name, plan in plans.items():
        assert plan.count() > 0, name
    ar3 = {r.series_id: r for r in plans["ar3"].where("date >= '2024-01-05'").collect()}
    assert ar3["normal"].yhat is not None and ar3["constant"].yhat is None
    dens = plans["kde"].groupBy("series_id").agg(F.count("density_count").alias("n")).collect()
    assert {r.series_id: r.n for r in dens} == {"normal": 10, "constant": 0, "short": 10, "one": 0}


def test_one_quantile_path(spark):
    r = np.random.default_rng(1)
    values = np.r_[r.normal(size=997), np.full(400, 0.25), [np.nan] * 5]
    df = spark.createDataFrame([(float(v), None, float(i)) for i, v in enumerate(values)], "a double, b double, c double").repartition(7)
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 1.0]
    got = order_statistics(df, ["a", "b", "c"], probs)
    clean = values[~np.isnan(values)]
    for p in probs:
        assert got.quantile("a", p) == pytest.approx(np.quantile(clean, p), rel=1e-12, abs=1e-12)
        assert got.quantile("c", p) == pytest.approx(np.quantile(np.arange(len(values)), p))
        assert got.quantile("b", p) is None
    assert got.quantile("a", 0.75, lambda x: min(x, 0.1)) == pytest.approx(np.quantile(np.minimum(clean, 0.1), 0.75))
    assert order_statistics(df.limit(0), ["a"], probs).quantile("a", 0.5) is None


def test_fits_without_training_rows(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, None)], "a double, b double")
    out = fit_robust_scaler(df, ["a", "b"]).transform(fit_fences(df, ["a", "b"]).transform(df)).collect()
    assert [r.b for r in out] == [None, None] and [r.a for r in out] == [-1.0, 1.0]
    assert fit_fences(df.limit(0), ["a"]).transform(df).count() == 2
    filled = fill_median(spark.createDataFrame([(None, 3.0)], "a double, b double"), fit_medians(df, ["a"]), ["a"]).first()
    assert filled.a == 1.5


def test_no_global_percentile_in_fits(spark, capsys):
    """No fit of a whole column merges all its values in one task."""
    import panelstack.operators.quantiles as q
    source = open(q.__file__).read()
    assert "F.percentile" not in source
    import panelstack.operators.stats as s
    assert "EXACT_GLOBAL" not in open(s.__file__).read()


def test_banded_histogram_counts_all_values(spark):
    df = spark.createDataFrame([("s", v) for v in (-1.0, -9.0, 0.0, 49.9, 250.0, 300.0, 480.0, None, float("nan"))], "series_id string, value double")
    rows = banded_histogram(df, K, "value").collect()
    assert sum(r["count"] for r in rows) == 7
    assert {(r.band_lo, r.bin_lo): r["count"] for r in rows} == {(None, -8.0): 1, (None, -16.0): 1, (0.0, 0.0): 1, (0.0, 48.0): 1, (250.0, 250.0): 1, (250.0, 298.0): 1, (250.0, 474.0): 1}


def test_confusion_matrix_is_complete_by_group(spark):
    df = spark.createDataFrame([("m", 0, 1), ("m", 0, 0), ("n", 2, 2)], "model string, truth int, predicted int")
    rows = confusion_matrix(df, "truth", "predicted", [0, 1, 2], by=["model"]).collect()
    assert len(rows) == 18 and sum(r.n for r in rows) == 3


def test_upsert_with_another_column_keeps_the_log(spark):
    path = scratch_path(spark, "log")
    day = dt.date(2024, 5, 1)
    first = spark.createDataFrame([("a", day, 1.0), ("b", day, 2.0)], "series_id string, prediction_date date, predicted double")
    upsert_predictions(spark, first, path, ["series_id", "prediction_date"])
    more = spark.createDataFrame([("a", day, 3.0, "x"), ("a", day, 3.0, "x"), ("c", day, 4.0, "x")], "series_id string, prediction_date date, predicted double, note string")
    out = upsert_predictions(spark, more, path, ["series_id", "prediction_date"]).collect()
    assert sorted((r.series_id, r.predicted, r.note) for r in out) == [("a", 3.0, "x"), ("b", 2.0, None), ("c", 4.0, "x")]


def test_upsert_passes_other_errors_on(spark):
    path = scratch_path(spark, "log")
    day = dt.date(2024, 5, 1)
    new = spark.createDataFrame([("a", day, 1.0)], "series_id string, prediction_date date, predicted double")
    upsert_predictions(spark, new, path, ["series_id", "prediction_date"])
    with pytest.raises(Exception, match="(?i)incompatible|cannot|mismatch|merge"):
        bad = spark.createDataFrame([("a", day, [1])], "series_id string, prediction_date date, predicted array<int>")
        upsert_predictions(spark, bad, path, ["series_id", "prediction_date"])
    assert spark.read.parquet(path).count() == 1


def test_saved_pipeline_scores_the_same_rows(spark):
    from panelstack.sources.fixtures import region_daily_panel
    panel = region_daily_panel(spark, SF_SMALL)
    pipe = FeaturePipeline(K, T, "value", ["n_orders"])
    pipe.fit_transform(panel)
    path = scratch_path(spark, "pipe")
    pipe.save(spark, path)
    again = FeaturePipeline.load(spark, path)
    assert again.state() == pipe.state()
    tail = last_n(panel, K, T, 40).drop("recency_rank")
    a, b = (p.transform(tail).orderBy(*K, T).collect() for p in (pipe, again))
    assert a == b
    days = to_daily_grid(tail.select(*K, T, "value", "n_orders"), K, T).count()
    assert len(a) == days and all(v is not None for r in a for c, v in r.asDict().items() if c in pipe.features)


def test_scores_need_complete_features(spark):
    df = spark.createDataFrame([(float(i), float(i), 2.0 * i) for i in range(20)], "a double, b double, y double")
    model = learn.ridge(df, ["a", "b"], "y")
    assert learn.score_regression(model, df, ["a"]).count() == 20
    with pytest.raises(Exception, match="(?i)null|NaN|assembl"):
        learn.score_regression(model, spark.createDataFrame([(None, 1.0)], "a double, b double"), ["a"]).collect()


def test_patience_keeps_the_best_prefix(spark):
    assert learn.best_prefix([3.0, 2.0, 2.5, 1.0, 1.5, 1.6], 2) == 4
    assert learn.best_prefix([3.0, 2.0, 2.5, 2.6, 1.0], 2) == 2
    r = random.Random(1)
    rows = [(float(i % 10), r.gauss(0, 1) + (i % 10 > 4) * 3, i % 5 == 0) for i in range(400)]
    df = spark.createDataFrame(rows, "x double, y double, held boolean")
    model = learn.boosted_regressor(df, ["x"], "y", "xgb", validation_col="held", patience=3, maxIter=20, maxDepth=2)
    assert 1 <= model.stages[-1].getNumTrees <= 20
    assert model.transform(df).agg(F.avg("prediction")).first()[0] == pytest.approx(df.agg(F.avg("y")).first()[0], abs=0.5)


def test_stratified_folds_have_exact_sizes(spark):
    df = spark.createDataFrame([(i, 0 if i < 900 else 1 if i < 1003 else None, float(i)) for i in range(1010)], "id long, label int, x double")
    folds = learn.stratified_folds(df, "label", 5)
    counts = {(r.label, r.fold): r["count"] for r in folds.groupBy("label", "fold").count().collect()}
    assert [counts[(0, f)] for f in range(5)] == [180] * 5 and sorted(counts[(1, f)] for f in range(5)) == [20, 20, 21, 21, 21]
    assert folds.count() == 1010
    moved = df.withColumn("x", F.col("x") + 1e-9)
    assert {(r.id, r.fold) for r in folds.collect()} == {(r.id, r.fold) for r in learn.stratified_folds(moved, "label", 5).collect()}


def test_shared_folder_is_required_off_local(monkeypatch):
    from panelstack import session

    class Context:
        master = "spark://host:7077"

        @staticmethod
        def getCheckpointDir():
            return None

    class Spark:
        sparkContext = Context()
        conf = type("C", (), {"get": staticmethod(lambda k, d=None: d)})()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Spark())


@pytest.mark.parametrize("estimator,grid", [("forest", {"numTrees": [2, 3], "maxDepth": [2]}), ("boosted", {"maxIter": [1, 2], "maxDepth": [2]})])
def test_grid_search_of_both_kinds(spark, estimator, grid):
    r = random.Random(2)
    rows = [(i, float(i % 3 + r.random()), i % 3) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, x double, label int")
    cv = learn.grid_search(df, ["x"], "label", [0, 1, 2], grid, k=3, estimator=estimator, parallelism=2)
    assert len(cv.avgMetrics) == 2 and max(cv.avgMetrics) > 0.8
    assert cv.bestModel.transform(df).count() == 120
    with pytest.raises(ValueError, match="folds"):
        learn.grid_search(df.limit(2), ["x"], "label", [0, 1, 2], grid, k=3, estimator=estimator)
