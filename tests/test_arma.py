import datetime as dt
import math

import numpy as np
import pytest

from panelstack.operators.arma import adf_p_value, ar_p_horizon, arma_search, arma_table, arma_walk_forward, augmented_dickey_fuller, max_lag_for

K, T = ["series_id"], "date"


def panel(spark, series: dict):
    day = dt.date(2020, 1, 1)
    rows = [(k, day + dt.timedelta(i), float(x) if x is not None else None) for k, xs in series.items() for i, x in enumerate(xs)]
    return spark.createDataFrame(rows, "series_id string, date date, value double").repartition(5)


def arma(n, phi, theta, seed, mean=80.0):
    r = np.random.default_rng(seed)
    e, y = r.standard_normal(n + 100) * 4, np.zeros(n + 100)
    for i in range(3, n + 100):
        y[i] = sum(a * y[i - j - 1] for j, a in enumerate(phi)) + e[i] + sum(b * e[i - j - 1] for j, b in enumerate(theta))
    return mean + y[100:]


def test_parameters_are_recovered(spark):
    df = panel(spark, {"ma": arma(6000, [], [0.6], 1), "ar": arma(6000, [0.5, 0.3], [], 2), "arma": arma(6000, [0.7], [0.4], 3), "flat": [5.0] * 100, "short": [1.0, 2.0, 4.0]})
    table = {(r.series_id, r.p, r.q): r for r in arma_table(df, K, T, "value").collect()}
    assert table["ma", 0, 1].theta == pytest.approx([0.6], abs=0.05) and table["ma", 0, 1].intercept == pytest.approx(80, abs=1)
    assert table["ar", 2, 0].phi == pytest.approx([0.5, 0.3], abs=0.05)
    m = table["arma", 1, 1]
    assert m.phi == pytest.approx([0.7], abs=0.05) and m.theta == pytest.approx([0.4], abs=0.06) and m.sigma == pytest.approx(4, abs=0.2)
    assert m.intercept == pytest.approx(80 * 0.3, abs=4)
    best = {r.series_id: (r.p, r.q) for r in arma_search(df, K, T, "value").collect()}
    assert set(best) == {"ma", "ar", "arma"}
    # An order that cannot explain the series never wins.
    assert best["ma"][1] >= 1 or best["ma"][0] == 3
    assert best["ar"][0] >= 1 and best["arma"] != (0, 0)


def test_walk_forward_equals_plain_recursion(spark):
    y = arma(400, [0.6], [0.5], 4)
    y = [None if i in (100, 350) else v for i, v in enumerate(y)]
    df = panel(spark, {"a": y, "b": arma(400, [0.2], [-0.4], 5)})
    from pyspark.sql import functions as F
    df = df.withColumn("split", F.when(F.col("date") < dt.date(2020, 12, 1), "train").otherwise("test"))
    coefs = spark.createDataFrame([("a", 32.0, [0.6, 0.1], [0.5], 4.0), ("b", 50.0, [], [-0.4, 0.1], 3.0)], "series_id string, intercept double, phi array<double>, theta array<double>, sigma double")
    got = {(r.series_id, r.date): r for r in arma_walk_forward(df, coefs, K, T, "value").collect()}
    for k, c, phi, theta, s in coefs.collect():
        rows = sorted((r.date, r.value, r.split) for r in df.where(F.col("series_id") == k).collect())
        e = [0.0] * len(rows)
        for i, (day, v, split) in enumerate(rows):
            past = [rows[i - j - 1][1] if i > j else None for j in range(len(phi))]
            point = None if None in past else c + sum(a * x for a, x in zip(phi, past, strict=True)) + sum(b * (e[i - j - 1] if i > j else 0.0) for j, b in enumerate(theta))
            e[i] = v - point if point is not None and v is not None else 0.0
            if split == "test":
                r = got.pop((k, day))
                assert (r.yhat is None) == (point is None) and (point is None or (r.yhat, r.upper - r.yhat) == pytest.approx((point, 1.96 * s)))
    assert not got


def test_horizon_bands_widen_to_the_process_spread(spark):
    df = panel(spark, {"a": arma(4000, [0.6, 0.2], [], 7), "flat": [5.0] * 50, "short": [1.0, 2.0]})
    rows = sorted(ar_p_horizon(df, K, T, "value", p=2, horizon=200).collect(), key=lambda r: r.h)
    assert {r.series_id for r in rows} == {"a"} and [r.h for r in rows] == list(range(1, 201))
    widths = [r.upper - r.lower for r in rows]
    assert all(b >= a - 1e-12 for a, b in zip(widths, widths[1:], strict=False))
    spread = math.sqrt(16 * (1 - 0.2) / ((1 + 0.2) * ((1 - 0.2) ** 2 - 0.6**2)))
    assert widths[-1] == pytest.approx(2 * 1.96 * spread, rel=0.15) and rows[-1].forecast == pytest.approx(80, abs=3)


@pytest.mark.parametrize(("stat", "p"), [(-3.43, 0.01), (-3.12, 0.025), (-2.86, 0.05), (-2.57, 0.10), (-0.44, 0.90), (-0.07, 0.95), (0.23, 0.975), (0.60, 0.99)])
def test_p_values_follow_the_published_table(stat, p):
    assert adf_p_value(stat) == pytest.approx(p, abs=0.005)


def test_augmented_dickey_fuller(spark):
    r = np.random.default_rng(9)
    walk = np.cumsum(r.standard_normal(1500))
    df = panel(spark, {"walk": walk, "still": arma(1500, [0.5, 0.2], [], 8), "flat": [5.0] * 50})
    got = {x.series_id: x for x in augmented_dickey_fuller(df, K, T, "value").collect()}
    assert set(got) == {"walk", "still"} and max_lag_for(1500) == 24
    assert got["walk"].p_value > 0.05 and not got["walk"].stationary and got["still"].p_value < 0.01 and got["still"].stationary
    # The same statistic by plain least squares at the chosen lag.
    for k, y in (("walk", walk), ("still", np.array([x for x in arma(1500, [0.5, 0.2], [], 8)]))):
        lag, d = got[k].lag, np.diff(y)
        rows = range(lag, len(d))
        x = np.array([[1.0, y[i], *[d[i - j] for j in range(1, lag + 1)]] for i in rows])
        t = d[lag:]
        beta = np.linalg.lstsq(x, t, rcond=None)[0]
        s2 = ((t - x @ beta) ** 2).sum() / (len(t) - x.shape[1])
        assert got[k].t_stat == pytest.approx(beta[1] / math.sqrt(s2 * np.linalg.inv(x.T @ x)[1, 1]), rel=1e-6) and got[k].n == len(t)
    assert augmented_dickey_fuller(df.limit(0), K, T, "value").count() == 0
