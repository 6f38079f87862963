import numpy as np
import pytest
from pyspark.sql import functions as F

from panelstack.operators.explain import fit_linear_moments, linear_contributions
from panelstack.operators.forecast import ar_fit, ar_p_fit
from panelstack.operators import learn
from panelstack.operators.learn import ridge


def test_ridge_matches_closed_form(spark):
    x = np.array([1, 2, 2, 7, 9, 30], dtype=float)
    i = np.arange(6, dtype=float)
    y = 3 * x + 2 * i
    df = spark.createDataFrame([(float(a), float(b), float(c)) for a, b, c in zip(x, i, y)], "x double, i double, y double")
    m = ridge(df, ["x", "i"], "y", alpha=10.0)
    coef = m.stages[-1].coefficients.toArray()
    assert coef == pytest.approx([3.0920341, 0.9865849], abs=1e-6)
    b0, b = fit_linear_moments(df, ["x", "i"], "y", alpha=10.0)
    assert b == pytest.approx([3.0920341, 0.9865849], abs=1e-6)


def _series(spark, values):
    return spark.createDataFrame([("s", i, float(v)) for i, v in enumerate(values)], "series_id string, t int, value double")


def test_ar_fits_match_numpy(spark):
    rng = np.random.default_rng(0)
    y = [50.0]
    for _ in range(400):
        y.append(10 + 0.6 * y[-1] + 0.2 * (y[-2] if len(y) > 1 else 50) + rng.normal(0, 3))
    df = _series(spark, y)
    a1 = ar_fit(df, ["series_id"], "t", "value").first()
    Y = np.array(y)
    X1 = np.column_stack([np.ones(len(Y) - 1), Y[:-1]])
    ref1 = np.linalg.lstsq(X1, Y[1:], rcond=None)[0]
    assert (a1.intercept, a1.phi) == pytest.approx(tuple(ref1), rel=1e-9)
    p = 3
    a3 = ar_p_fit(df, ["series_id"], "t", "value", p=p).first()
    X = np.column_stack([np.ones(len(Y) - p)] + [Y[p - k:len(Y) - k] for k in range(1, p + 1)])
    ref = np.linalg.lstsq(X, Y[p:], rcond=None)[0]
    assert [a3.intercept, a3.phi_1, a3.phi_2, a3.phi_3] == pytest.approx(list(ref), rel=1e-7)


def test_linear_contributions_are_additive(spark):
    rng = np.random.default_rng(1)
    rows = [(i, float(a), float(b), float(2 + 3 * a - b + rng.normal())) for i, (a, b) in
            enumerate(rng.normal(size=(200, 2)))]
    df = spark.createDataFrame(rows, "id int, a double, b double, y double")
    b0, coefs = fit_linear_moments(df, ["a", "b"], "y")
    means = {r: float(df.agg(F.avg(r)).first()[0]) for r in ["a", "b"]}
    c = linear_contributions(df, ["id"], ["a", "b"], b0, coefs, means)
    g = c.groupBy("id", "prediction", "base").agg(F.sum("contribution").alias("s"))
    worst = g.select(F.max(F.abs(F.col("base") + F.col("s") - F.col("prediction")))).first()[0]
    assert worst < 1e-9


def test_early_stopping_fits_few_rounds_beyond_its_patience(spark, monkeypatch):
    fitted = []

    class Counted(learn.GBTRegressor):
        def fit(self, dataset, params=None):
            fitted.append(self.getMaxIter())
            return super().fit(dataset, params)

    monkeypatch.setattr(learn, "GBTRegressor", Counted)
    rng = np.random.default_rng(3)
    rows = [(float(i % 7), float(rng.normal()), i % 4 == 0) for i in range(240)]  # nothing to learn
    df = spark.createDataFrame(rows, "x double, y double, held boolean").coalesce(1).persist()
    fits = {name: lambda seed=seed: learn.boosted_regressor(df, ["x"], "y", "xgb", "held", 5, seed, maxIter=12, maxDepth=1) for name, seed in (("a", 1), ("b", 7))}
    models = learn.side_by_side(spark, fits)
    assert list(models) == ["a", "b"] and df.storageLevel.useMemory  # the caller's frame stays persisted
    assert fitted.count(6) >= 2 and min(fitted[:2]) == 6
    for name, seed in (("a", 1), ("b", 7)):  # the same trees as all rounds fitted, up to the best one
        whole = learn.boosted_regressor(df.where("not held"), ["x"], "y", "xgb", seed=seed, maxIter=12, maxDepth=1)
        losses = whole.stages[-1].evaluateEachIteration(whole.stages[0].transform(df.where("held")), "squared")
        keep, kept = learn.best_prefix(list(losses), 5), models[name].stages[-1]
        assert kept.getNumTrees == keep
        assert [t.toDebugString.split("\n", 1)[1] for t in kept.trees] == [t.toDebugString.split("\n", 1)[1] for t in whole.stages[-1].trees[:keep]]
    df.unpersist()
