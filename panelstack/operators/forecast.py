"""Per-series autoregressive baselines and the Dickey-Fuller statistic.

AR(1) is fitted per series with the regression aggregates (``regr_slope``,
``regr_intercept``, ``regr_sxx`` ...), i.e. one grouped aggregate with map-side
combine; AR(p) aggregates the normal-equation moments per series in the same
way and solves the p x p systems of a batch of series at once (one moment row a
series, whatever the history length).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelstack.functions.bands import clip, nan_to_null

Z95 = 1.96


def _with_lags(df: DataFrame, keys, t, v, p: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(t)
    return df.withColumns({f"_y{i}": F.lag(F.col(v), i).over(w) for i in range(1, p + 1)})


def ar_fit(df: DataFrame, keys: list[str], t: str, v: str) -> DataFrame:
    """AR(1) with constant per series: intercept, phi, residual sigma (n-2 dof), n."""
    x = _with_lags(df, keys, t, v, 1)
    y, y1 = F.col(v), F.col("_y1")
    g = x.groupBy(*keys).agg(F.regr_intercept(y, y1).alias("intercept"), F.regr_slope(y, y1).alias("phi"),
                             F.regr_syy(y, y1).alias("_syy"), F.regr_sxy(y, y1).alias("_sxy"),
                             F.regr_count(y, y1).alias("n"))
    ssr = F.col("_syy") - F.col("phi") * F.col("_sxy")
    return g.withColumn("sigma", F.sqrt(F.try_divide(ssr, F.col("n") - 2))).drop("_syy", "_sxy")


def ar1_score_rows(df: DataFrame, coefs: DataFrame, keys: list[str], t: str, v: str,
                   lo: float = 0.0, hi: float = 500.0) -> DataFrame:
    """One-step forecasts made on each day for the next day, with the true history as input."""
    j = df.join(coefs.select(*keys, "intercept", "phi", "sigma"), on=keys, how="inner")
    point = F.col("intercept") + F.col("phi") * F.col(v)
    return j.select(*keys, F.col(t).alias("prediction_date"), F.date_add(F.col(t), 1).alias("predicted_for_date"),
                    F.col(v).alias("actual_today"), clip(point, lo, hi).alias("predicted"),
                    (point - Z95 * F.col("sigma")).alias("lower"), (point + Z95 * F.col("sigma")).alias("upper"))


def ar1_walk_forward(df: DataFrame, keys: list[str], t: str, v: str, split_col: str = "split",
                     lo: float = 0.0, hi: float = 500.0) -> DataFrame:
    """Fit on ``train`` rows; predict each ``test`` day from the true previous day (no refit)."""
    coefs = ar_fit(df.where(F.col(split_col) == "train"), keys, t, v)
    x = _with_lags(df, keys, t, v, 1).where(F.col(split_col) == "test")
    j = x.join(coefs, on=keys, how="inner")
    point = F.col("intercept") + F.col("phi") * F.col("_y1")
    return j.select(*keys, t, F.col(v).alias("y"), clip(point, lo, hi).alias("yhat"),
                    (point - Z95 * F.col("sigma")).alias("lower"), (point + Z95 * F.col("sigma")).alias("upper"))


def ar1_multistep(df: DataFrame, keys: list[str], t: str, v: str, horizon: int = 30) -> DataFrame:
    """Iterate the fitted AR(1) from each series' last value: mu + phi^h (x_T - mu), mu = c / (1 - phi)."""
    coefs = ar_fit(df, keys, t, v)
    last = df.groupBy(*keys).agg(F.max_by(F.col(v), F.col(t)).alias("_x"), F.max(t).alias("_t"))
    j = last.join(coefs, on=keys).withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    mu = F.try_divide(F.col("intercept"), F.lit(1.0) - F.col("phi"))
    return j.select(*keys, "h", F.date_add(F.col("_t"), F.col("h")).alias(t),
                    (mu + F.pow(F.col("phi"), F.col("h")) * (F.col("_x") - mu)).alias("forecast"))


def ar_p_fit(df: DataFrame, keys: list[str], t: str, v: str, p: int = 3) -> DataFrame:
    """AR(p) with constant by least squares per series from aggregated, centred moments.

    Spark aggregates the means and population (co)variances of y_{t-1} .. y_{t-p}
    and y_t per series (one map-side-combined aggregate); each series' p x p
    system is solved with NumPy, a batch of moment rows at a time.
    Centring keeps the system well conditioned for persistent series.
    """
    x = _with_lags(df, keys, t, v, p)
    lags = [f"_y{i}" for i in range(1, p + 1)]
    complete = F.col(v).isNotNull()
    for c in lags:
        complete = complete & F.col(c).isNotNull()
    x = x.where(complete)
    aggs = [F.avg(c).alias(f"m_{i}") for i, c in enumerate(lags)] + [F.avg(v).alias("m_y")]
    aggs += [F.covar_pop(lags[i], lags[j]).alias(f"c_{i}_{j}") for i in range(p) for j in range(i, p)]
    aggs += [F.covar_pop(lags[i], v).alias(f"c_{i}_y") for i in range(p)]
    aggs += [F.var_pop(v).alias("v_y"), F.count(F.lit(1)).alias("n")]
    moments = x.groupBy(*keys).agg(*aggs)
    key_types = {f.name: f.dataType.simpleString() for f in moments.schema.fields if f.name in keys}
    coef_fields = ", ".join(["intercept double"] + [f"phi_{i} double" for i in range(1, p + 1)])
    schema = ", ".join(f"{k} {key_types[k]}" for k in keys) + f", {coef_fields}, sigma double, n long"

    def solve(batches):
        """All systems of a batch at once; a singular one (constant or short series) has null coefficients."""
        for m in batches:
            cov = np.zeros((len(m), p, p))
            for i in range(p):
                for j in range(i, p):
                    cov[:, i, j] = cov[:, j, i] = m[f"c_{i}_{j}"]
            cy, mean = (np.stack([m[f"{c}_{i}{e}"] for i in range(p)], axis=1).astype(float) for c, e in (("c", "_y"), ("m", "")))
            size = np.einsum("nii->n", cov) / p
            good = (m["n"].to_numpy() > p + 1) & (size > 0) & np.isfinite(cov).all(axis=(1, 2))
            good[good] = np.linalg.cond(cov[good]) < 1e12
            beta = np.full((len(m), p), np.nan)
            beta[good] = np.linalg.solve(cov[good], cy[good][:, :, None])[:, :, 0]
            n = m["n"].to_numpy()
            ssr = n * (m["v_y"].to_numpy() - (beta * cy).sum(axis=1))
            out = m[keys].copy()
            out["intercept"] = m["m_y"].to_numpy() - (beta * mean).sum(axis=1)
            for i in range(p):
                out[f"phi_{i + 1}"] = beta[:, i]
            out["sigma"], out["n"] = np.sqrt(np.maximum(ssr, 0) / np.maximum(n - (p + 1), 1)), n
            yield out

    solved = moments.mapInPandas(solve, schema)
    return solved.withColumns({c: nan_to_null(c) for c in ["intercept", "sigma", *[f"phi_{i}" for i in range(1, p + 1)]]})


def ar_p_walk_forward(df: DataFrame, keys: list[str], t: str, v: str, p: int = 3, split_col: str = "split",
                      lo: float = 0.0, hi: float = 500.0) -> DataFrame:
    coefs = ar_p_fit(df.where(F.col(split_col) == "train"), keys, t, v, p)
    x = _with_lags(df, keys, t, v, p).where(F.col(split_col) == "test").join(coefs, on=keys)
    point = F.col("intercept")
    for i in range(1, p + 1):
        point = point + F.col(f"phi_{i}") * F.col(f"_y{i}")
    return x.select(*keys, t, F.col(v).alias("y"), clip(point, lo, hi).alias("yhat"))


def dickey_fuller(df: DataFrame, keys: list[str], t: str, v: str, critical: float = -2.86) -> DataFrame:
    """t statistic of rho in  dy_t = a + rho * y_{t-1} + e  (no lagged differences), per series."""
    x = _with_lags(df, keys, t, v, 1)
    dy, y1 = F.col(v) - F.col("_y1"), F.col("_y1")
    g = x.groupBy(*keys).agg(F.regr_slope(dy, y1).alias("rho"), F.regr_sxx(dy, y1).alias("_sxx"),
                             F.regr_syy(dy, y1).alias("_syy"), F.regr_sxy(dy, y1).alias("_sxy"),
                             F.regr_count(dy, y1).alias("n"))
    ssr = F.col("_syy") - F.col("rho") * F.col("_sxy")
    se = F.sqrt(F.try_divide(F.try_divide(ssr, F.col("n") - 2), F.col("_sxx")))
    return (g.withColumn("t_stat", F.try_divide(F.col("rho"), se))
            .withColumn("stationary", F.col("t_stat") < F.lit(critical)).drop("_sxx", "_syy", "_sxy"))
