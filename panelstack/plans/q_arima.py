"""ARMA with order search, AR forecasts to a horizon, augmented Dickey-Fuller (M16-M18)."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelstack.operators.arma import (
    ADF_ENDS, ADF_LARGE, ADF_SMALL, ADF_TURN, adf_table, ar_p_horizon, arma_search, arma_table, arma_walk_forward, augmented_dickey_fuller,
)
from panelstack.operators.forecast import Z95
from panelstack.operators.metrics import regression_metrics
from panelstack.operators.windows import time_split
from panelstack.plans.panels import K, p2_filled
from panelstack.plans.registry import register
from panelstack.plans.sqlparts import P2I, W, clip

T = "date"


def det(m: list[list[str]]) -> str:
    """Determinant of a matrix of SQL terms, by its first row."""
    if len(m) == 1:
        return f"({m[0][0]})"
    minors = [[row[:j] + row[j + 1:] for row in m[1:]] for j in range(len(m))]
    return "(" + " ".join(f"{'-' if j % 2 else '+'} ({m[0][j]}) * {det(minor)}" for j, minor in enumerate(minors)) + ")"


def _regression(y: str, xs: list[str]) -> tuple[str, list[str], list[str], str, str]:
    """SQL of a least-squares fit with constant: moment columns, slopes, means, the error sum, and entry 1,1 of the inverse covariance."""
    names = [f"s_{i}_{j}" for i in range(len(xs)) for j in range(i, len(xs))]
    moments = ", ".join([f"count({y}) AS n", f"avg({y}) AS m_y", f"var_pop({y}) AS v_y", *[f"avg({c}) AS m_{i}" for i, c in enumerate(xs)],
                         *[f"covar_pop({xs[int(n.split('_')[1])]}, {xs[int(n.split('_')[2])]}) AS {n}" for n in names], *[f"covar_pop({c}, {y}) AS s_{i}_y" for i, c in enumerate(xs)]])
    cov = [[f"s_{min(i, j)}_{max(i, j)}" for j in range(len(xs))] for i in range(len(xs))]
    betas = [f"{det([[f's_{r}_y' if c == k else cov[r][c] for c in range(len(xs))] for r in range(len(xs))])} / {det(cov)}" for k in range(len(xs))]
    error = "n * (v_y - " + " - ".join(f"({b}) * s_{i}_y" for i, b in enumerate(betas)) + ")"
    inverse = f"{det([row[1:] for row in cov[1:]])} / {det(cov)}" if len(xs) > 1 else "1.0 / s_0_0"
    return moments, betas, [f"m_{i}" for i in range(len(xs))], error, inverse


# --- augmented Dickey-Fuller ------------------------------------------------------------------------------

ADF_ROWS = f"""{P2I},
a0 AS (SELECT series_id, date, value - lag(value, 1) OVER ({W}) AS dy, lag(value, 1) OVER ({W}) AS y1 FROM p2i),
a AS (SELECT *, lag(dy, 1) OVER ({W}) AS d1, lag(dy, 2) OVER ({W}) AS d2 FROM a0)"""


def _adf_fits(where: list[str]) -> str:
    """One row a series and lag order 0, 1, 2, each on the rows of its condition."""
    parts = []
    for k in range(3):
        moments, betas, _, error, inverse = _regression("dy", ["y1", "d1", "d2"][:k + 1])
        parts.append(f"""SELECT series_id, {k} AS lag, n, {betas[0]} AS rho, ({betas[0]}) / sqrt({error} / (n - {k + 2}) * {inverse} / n) AS t_stat,
n * (ln(2 * pi() * {error} / n) + 1) + {2 * (k + 2)} AS aic FROM (SELECT series_id, {moments} FROM a WHERE {where[k]} GROUP BY 1)""")
    return " UNION ALL ".join(parts)


@register("adf_lags", f"WITH {ADF_ROWS} {_adf_fits(['d2 IS NOT NULL'] * 3)}", doubles="rho t_stat aic", ints="lag n")
def q_adf_lags(spark, sf_dir):
    """Unit-root regressions of lag orders 0, 1 and 2 on one sample."""
    return adf_table(p2_filled(spark, sf_dir), K, T, "value", 2)


def _normal(z: str) -> str:
    """Distribution function of the normal law, by Simpson's rule on 400 intervals from 0 to z."""
    total = f"list_sum(list_transform(range(0, 401), lambda i: CASE WHEN i IN (0, 400) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp(-power(({z}) * i / 400, 2) / 2)))"
    return f"(0.5 + ({z}) / 1200 * {total} / sqrt(2 * pi()))"


def _surface(terms: tuple) -> str:
    return " + ".join(f"{c} * power(t_stat, {i})" for i, c in enumerate(terms))


@register("adf_test", f"""
WITH {ADF_ROWS}, common AS ({_adf_fits(['d2 IS NOT NULL'] * 3)}),
best AS (SELECT series_id, arg_min(lag, aic) AS lag FROM common GROUP BY 1),
own AS ({_adf_fits(['dy IS NOT NULL', 'd1 IS NOT NULL', 'd2 IS NOT NULL'])}),
f AS (SELECT o.series_id, o.lag, o.n, o.t_stat, CASE WHEN t_stat <= {ADF_TURN} THEN {_surface(ADF_SMALL)} ELSE {_surface(ADF_LARGE)} END AS z FROM own o JOIN best USING (series_id, lag)),
p AS (SELECT *, CASE WHEN t_stat > {ADF_ENDS[1]} THEN 1.0 WHEN t_stat < {ADF_ENDS[0]} THEN 0.0 ELSE {_normal('z')} END AS p_value FROM f)
SELECT series_id, lag, n, t_stat, p_value, p_value < 0.05 AS stationary FROM p""", doubles="t_stat p_value", ints="lag n")
def q_adf_test(spark, sf_dir):
    """Augmented Dickey-Fuller with the lag order of least AIC among 0, 1, 2, its statistic and p-value."""
    return augmented_dickey_fuller(p2_filled(spark, sf_dir), K, T, "value", max_lag=2)


@register("adf_auto")
def q_adf_auto(spark, sf_dir):
    """The same with the usual bound on the lag order (27 at 2,400 days)."""
    return augmented_dickey_fuller(p2_filled(spark, sf_dir), K, T, "value")


# --- AR(3) to a horizon -------------------------------------------------------------------------------------

def _ar3_ctes(where: str) -> str:
    moments, betas, means, error, _ = _regression("value", ["y1", "y2", "y3"])
    return f"""{P2I},
s AS (SELECT series_id, date, value, lag(value, 1) OVER ({W}) AS y1, lag(value, 2) OVER ({W}) AS y2, lag(value, 3) OVER ({W}) AS y3, row_number() OVER ({W}) AS rn,
      CASE WHEN row_number() OVER ({W}) > count(*) OVER (PARTITION BY series_id) - ceil(count(*) OVER (PARTITION BY series_id) * 0.2) THEN 'test' ELSE 'train' END AS split FROM p2i),
mo AS (SELECT series_id, {moments} FROM s WHERE y3 IS NOT NULL AND {where} GROUP BY 1),
co AS (SELECT series_id, {', '.join(f'{b} AS b{i + 1}' for i, b in enumerate(betas))}, sqrt(({error}) / (n - 4)) AS sigma, m_y, {', '.join(means)} FROM mo),
c AS (SELECT series_id, b1, b2, b3, sigma, m_y - b1 * m_0 - b2 * m_1 - b3 * m_2 AS b0 FROM co)"""


@register("ar3_horizon", f"""
WITH RECURSIVE {_ar3_ctes('true')},
e AS (SELECT series_id, arg_max(value, date) AS x1, arg_max(y1, date) AS x2, arg_max(y2, date) AS x3, max(date) AS t FROM s GROUP BY 1),
h AS (SELECT c.*, e.t, 1 AS h, b0 + b1 * x1 + b2 * x2 + b3 * x3 AS f, x1, x2, CAST(1.0 AS DOUBLE) AS w1, CAST(0.0 AS DOUBLE) AS w2, CAST(0.0 AS DOUBLE) AS w3, CAST(1.0 AS DOUBLE) AS var FROM e JOIN c USING (series_id)
      UNION ALL SELECT series_id, b1, b2, b3, sigma, b0, t, h + 1, b0 + b1 * f + b2 * x1 + b3 * x2, f, x1, b1 * w1 + b2 * w2 + b3 * w3, w1, w2,
      var + power(b1 * w1 + b2 * w2 + b3 * w3, 2) FROM h WHERE h < 30)
SELECT series_id, h, CAST(t + h AS DATE) AS date, f AS forecast, f - {Z95} * sigma * sqrt(var) AS lower, f + {Z95} * sigma * sqrt(var) AS upper FROM h""",
          doubles="forecast lower upper", ints="h")
def q_ar3_horizon(spark, sf_dir):
    """Thirty days ahead by AR(3), with bands that widen."""
    return ar_p_horizon(p2_filled(spark, sf_dir), K, T, "value", p=3, horizon=30)


# --- ARMA -------------------------------------------------------------------------------------------------------

@register("ma1_forecast", f"""
WITH RECURSIVE {_ar3_ctes("split = 'train'")},
r AS (SELECT s.*, value - (b0 + b1 * y1 + b2 * y2 + b3 * y3) AS e FROM s JOIN c USING (series_id) WHERE split = 'train'),
r1 AS (SELECT *, lag(e, 1) OVER ({W}) AS e1 FROM r),
ma AS (SELECT series_id, regr_intercept(value, e1) AS a, regr_slope(value, e1) AS theta,
       sqrt((regr_syy(value, e1) - regr_slope(value, e1) * regr_sxy(value, e1)) / (regr_count(value, e1) - 2)) AS sigma FROM r1 GROUP BY 1),
w AS (SELECT s.series_id, CAST(1 AS BIGINT) AS rn, ma.a AS point, s.value - ma.a AS shock FROM s JOIN ma USING (series_id) WHERE s.rn = 1
      UNION ALL SELECT s.series_id, s.rn, ma.a + ma.theta * w.shock, s.value - (ma.a + ma.theta * w.shock) FROM w JOIN s ON s.series_id = w.series_id AND s.rn = w.rn + 1 JOIN ma ON ma.series_id = w.series_id)
SELECT s.series_id, s.date, s.value AS y, {clip('w.point', 0.0, 500.0)} AS yhat, w.point - {Z95} * ma.sigma AS lower, w.point + {Z95} * ma.sigma AS upper
FROM w JOIN s USING (series_id, rn) JOIN ma USING (series_id) WHERE s.split = 'test'""", doubles="y yhat lower upper")
def q_ma1_forecast(spark, sf_dir):
    """One moving-average term: residuals of AR(3), one regression, then the innovations recursion over the test days."""
    rows = time_split(p2_filled(spark, sf_dir), K, T)
    fit = arma_table(rows.where(F.col("split") == "train"), K, T, "value", max_p=0, max_q=1, long_order=3).where("q = 1")
    return arma_walk_forward(rows, fit, K, T, "value")


@register("arma_orders")
def q_arma_orders(spark, sf_dir):
    """AIC of all orders up to (3, 3) of every series, on the training days."""
    rows = time_split(p2_filled(spark, sf_dir), K, T).where(F.col("split") == "train")
    return arma_table(rows, K, T, "value").select(*K, "p", "q", "n", "intercept", "sigma", "aic")


@register("arma_metrics")
def q_arma_metrics(spark, sf_dir):
    """The order of least AIC of every series, walked forward over the test days without a refit."""
    rows = time_split(p2_filled(spark, sf_dir), K, T)
    found = arma_walk_forward(rows, arma_search(rows.where(F.col("split") == "train"), K, T, "value"), K, T, "value")
    return regression_metrics(found.withColumn("model", F.lit("arma")), ["model"])


def _small_orders_sql() -> str:
    parts = []
    for p, q in ((0, 0), (0, 1), (1, 0), (1, 1)):
        xs, k = ["y1"] * p + ["e1"] * q, p + q + 1
        if xs:
            moments, betas, means, error, _ = _regression("value", xs)
        else:
            moments, betas, means, error = "count(value) AS n, avg(value) AS m_y, var_pop(value) AS v_y", [], [], "n * v_y"
        point = "m_y" + "".join(f" - ({b}) * {m}" for b, m in zip(betas, means))
        parts.append(f"SELECT series_id, {p} AS p, {q} AS q, n, {point} AS intercept, sqrt({error} / (n - {k})) AS sigma, n * ln({error} / n) + {2 * k} AS aic "
                     f"FROM (SELECT series_id, {moments} FROM r1 WHERE e1 IS NOT NULL GROUP BY 1)")
    return " UNION ALL ".join(parts)


@register("arma_orders_small", f"""
WITH {_ar3_ctes("split = 'train'")},
r AS (SELECT s.*, value - (b0 + b1 * y1 + b2 * y2 + b3 * y3) AS e FROM s JOIN c USING (series_id) WHERE split = 'train'),
r1 AS (SELECT *, lag(e, 1) OVER ({W}) AS e1 FROM r)
{_small_orders_sql()}""", doubles="intercept sigma aic", ints="p q n")
def q_arma_orders_small(spark, sf_dir):
    """Orders up to (1, 1) with the residuals of AR(3): every regression of the table in closed form."""
    rows = time_split(p2_filled(spark, sf_dir), K, T).where(F.col("split") == "train")
    return arma_table(rows, K, T, "value", max_p=1, max_q=1, long_order=3).select(*K, "p", "q", "n", "intercept", "sigma", "aic")
