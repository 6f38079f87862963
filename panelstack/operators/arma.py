"""ARMA models, their order search, AR forecasts to a horizon and the augmented Dickey-Fuller test, per series.

Every regression comes from one table of sums of products a series (partial sums leave a task
already added up); the systems of a batch of series are solved with NumPy.  Values are centred by
their series' mean first, which keeps the sums well conditioned.  Only the innovations
recursion goes through a series in order: it streams over sorted rows and carries a few values.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelstack.functions.bands import clip, nan_to_null
from panelstack.operators.forecast import Z95, ar_p_fit
from panelstack.operators.windows import last_n
from panelstack.session import materialize


# --- moments ------------------------------------------------------------------------------------------

def _products(keys: list[str], cols: list[str]):
    """Function for mapInPandas: of each key of a batch the sums of all products of (1, columns) over complete rows, upper triangle by rows."""
    upper = np.triu_indices(len(cols) + 1)

    def run(batches):
        for pdf in batches:
            out = []
            for key, g in pdf.dropna(subset=cols).groupby(keys, sort=False, dropna=False):
                x = np.column_stack([np.ones(len(g)), g[cols].to_numpy(float)])
                out.append((*key, (x.T @ x)[upper].tolist()))
            if out:
                yield pd.DataFrame(out, columns=[*keys, "part"])

    return run


def moments(rows: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """keys, sums: the upper triangle of the products of (1, columns), over rows without nulls in them.

    Incomplete rows are left out by the task function: a filter on dozens of columns would slow the planner down.
    """
    parts = rows.select(*keys, *cols).mapInPandas(_products(keys, cols), f"{_key_fields(rows, keys)}, part array<double>")
    summed = parts.select(*keys, F.posexplode("part").alias("i", "s")).groupBy(*keys, "i").agg(F.sum("s").alias("s"))
    return summed.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "s"))), lambda x: x["s"]).alias("sums"))


def _square(sums, size: int) -> np.ndarray:
    m = np.zeros((size, size))
    m[np.triu_indices(size)] = sums
    return m + np.triu(m, 1).T


def _least_squares(m: np.ndarray, y: int, x: list[int]) -> tuple[np.ndarray, float, np.ndarray] | None:
    """Coefficients, squared error sum and inverse of the products, from a products matrix; None where it is singular."""
    xx = m[np.ix_(x, x)]
    size = np.sqrt(np.diag(xx))
    if not (size > 0).all() or np.linalg.cond(xx / np.outer(size, size)) > 1e12:
        return None
    inverse = np.linalg.inv(xx / np.outer(size, size)) / np.outer(size, size)
    beta = inverse @ m[x, y]
    return beta, float(m[y, y] - beta @ m[x, y]), inverse


def _centred(df: DataFrame, keys: list[str], t: str, v: str) -> DataFrame:
    """The rows with the series' mean and the centred value, ``_mean`` and ``_y``."""
    mean = df.groupBy(*keys).agg(F.avg(v).alias("_mean"))
    return df.join(mean, keys).withColumn("_y", F.col(v) - F.col("_mean"))


def _lags(df: DataFrame, keys: list[str], t: str, col: str, name: str, n: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(t)
    return df.withColumns({f"{name}{i}": F.lag(col, i).over(w) for i in range(1, n + 1)})


def _key_fields(df: DataFrame, keys: list[str]) -> str:
    types = dict(df.dtypes)
    return ", ".join(f"`{k}` {types[k]}" for k in keys)


# --- augmented Dickey-Fuller --------------------------------------------------------------------------

# Response surface of the p-value (constant, one series): below the turning point a quadratic, above it a
# cubic in the statistic goes through the normal distribution; beyond the ends p is 0 or 1.
ADF_TURN, ADF_ENDS = -1.61, (-18.83, 2.74)
ADF_SMALL, ADF_LARGE = (2.1659, 1.4412, 0.038269), (1.7339, 0.93202, -0.12745, -0.010368)


def adf_p_value(stat: float) -> float:
    if stat > ADF_ENDS[1]:
        return 1.0
    if stat < ADF_ENDS[0]:
        return 0.0
    z = sum(c * stat**i for i, c in enumerate(ADF_SMALL if stat <= ADF_TURN else ADF_LARGE))
    return 0.5 * (1 + math.erf(z / math.sqrt(2)))


def _adf_rows(df: DataFrame, keys: list[str], t: str, v: str, max_lag: int) -> DataFrame:
    """dy and its regressors: y1 (level before), d1 .. d_max."""
    w = Window.partitionBy(*keys).orderBy(t)
    x = _centred(df.where(F.col(v).isNotNull()), keys, t, v).withColumn("y1", F.lag("_y", 1).over(w))
    x = materialize(x.select(*keys, t, "y1", (F.col("_y") - F.col("y1")).alias("dy")), "adf-rows")
    return _lags(x, keys, t, "dy", "d", max_lag)


def adf_table(df: DataFrame, keys: list[str], t: str, v: str, max_lag: int) -> DataFrame:
    """Every lag order 0 .. max_lag of the regression  dy = a + rho y1 + sum c_i d_i  on one sample: keys, lag, n, rho, t_stat, aic.

    All orders are nested in one matrix of products a series.  A singular system (constant or short series) has nulls.
    """
    return _adf_orders(_adf_rows(df, keys, t, v, max_lag), keys, max_lag)


def _adf_orders(rows: DataFrame, keys: list[str], max_lag: int) -> DataFrame:
    cols = ["dy", "y1", *[f"d{i}" for i in range(1, max_lag + 1)]]
    made = moments(rows, keys, cols)

    def solve(batches):
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                m, key = _square(row.sums, len(cols) + 1), tuple(row)[:len(keys)]
                out += [(*key, k, *_adf_fit(m, k)) for k in range(max_lag + 1)]
            yield pd.DataFrame(out, columns=[*keys, "lag", "n", "rho", "t_stat", "aic"])

    found = made.select(*keys, "sums").mapInPandas(solve, f"{_key_fields(rows, keys)}, lag int, n long, rho double, t_stat double, aic double")
    return found.withColumns({c: nan_to_null(c) for c in ("rho", "t_stat", "aic")})


def _adf_fit(m: np.ndarray, k: int) -> tuple[int, float, float, float]:
    """n, rho, its t statistic and the AIC at lag order k; columns of ``m``: 1, dy, y1, d1 ..."""
    n = int(round(m[0, 0]))
    fit = _least_squares(m, 1, [0, 2, *range(3, 3 + k)]) if n > k + 2 else None
    if fit is None or fit[1] <= 0:
        return n, math.nan, math.nan, math.nan
    beta, error, inverse = fit
    return n, float(beta[1]), float(beta[1] / math.sqrt(error / (n - k - 2) * inverse[1, 1])), n * (math.log(2 * math.pi * error / n) + 1) + 2 * (k + 2)


def max_lag_for(n: int) -> int:
    """The usual bound on the lag order, 12 (n / 100)^(1/4), and at most what the sample bears."""
    return max(0, min(n // 2 - 2, math.ceil(12 * (n / 100) ** 0.25)))


def augmented_dickey_fuller(df: DataFrame, keys: list[str], t: str, v: str, max_lag: int | None = None, level: float = 0.05) -> DataFrame:
    """keys, lag (least AIC on the common sample), n, t_stat and p_value (fitted again on all rows that this lag leaves), stationary.

    ``max_lag`` defaults to the usual bound for the longest series.
    """
    if max_lag is None:
        longest = df.where(F.col(v).isNotNull()).groupBy(*keys).count().agg(F.max("count")).first()[0]
        max_lag = max_lag_for(longest or 0)
    rows = _adf_rows(df, keys, t, v, max_lag)
    table = _adf_orders(rows, keys, max_lag).where(F.col("aic").isNotNull())
    best = materialize(table.groupBy(*keys).agg(F.min_by("lag", F.struct("aic", "lag")).alias("lag")), "adf-lags")
    # The second fit: lags beyond the chosen one are out of the way (zero), so they cost no rows.
    rows = rows.join(best, keys)
    rows = rows.withColumns({f"d{i}": F.when(F.col("lag") >= i, F.col(f"d{i}")).otherwise(0.0) for i in range(1, max_lag + 1)})
    cols = ["dy", "y1", *[f"d{i}" for i in range(1, max_lag + 1)]]
    made = moments(rows, keys, cols).join(best, keys)

    def solve(batches):
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                n, _, stat, _ = _adf_fit(_square(row.sums, len(cols) + 1), int(row.lag))
                out.append((*tuple(row)[:len(keys)], int(row.lag), n, stat, adf_p_value(stat) if math.isfinite(stat) else math.nan))
            yield pd.DataFrame(out, columns=[*keys, "lag", "n", "t_stat", "p_value"])

    found = made.select(*keys, "sums", "lag").mapInPandas(solve, f"{_key_fields(df, keys)}, lag int, n long, t_stat double, p_value double")
    return found.withColumns({c: nan_to_null(c) for c in ("t_stat", "p_value")}).withColumn("stationary", F.col("p_value") < level)


# --- AR(p) to a horizon ---------------------------------------------------------------------------------

def ar_p_horizon(df: DataFrame, keys: list[str], t: str, v: str, p: int = 3, horizon: int = 30, z: float = Z95) -> DataFrame:
    """keys, h, date, forecast, lower, upper: AR(p) iterated from each series' last values, with widening bands.

    The forecast recursion and the psi weights (the model's answer to one shock) both append to an array
    the sum of the last p entries times the coefficients; the variance at h is sigma^2 times the sum of the first h squared
    weights.  A series without a fit or with fewer than p values has none.
    """
    coefs = ar_p_fit(df, keys, t, v, p)
    tail = last_n(df.where(F.col(v).isNotNull()), keys, t, p).groupBy(*keys).agg(
        F.transform(F.sort_array(F.collect_list(F.struct(t, v))), lambda x: x[v]).alias("_y"), F.max(t).alias("_t"))
    x = tail.join(coefs, keys).where(F.col("intercept").isNotNull() & (F.size("_y") == p))

    def extend(start: F.Column, constant: F.Column) -> F.Column:
        def step(acc, _):
            total = constant
            for i in range(1, p + 1):
                total = total + F.col(f"phi_{i}") * F.element_at(acc, -i)
            return F.concat(acc, F.array(total))
        return F.aggregate(F.sequence(F.lit(1), F.lit(horizon)), start, step)

    shock = F.array(*[F.lit(0.0)] * (p - 1), F.lit(1.0))
    x = x.select(*keys, "_t", "sigma", F.slice(extend(F.col("_y"), F.col("intercept")), p + 1, horizon).alias("_f"), F.slice(extend(shock, F.lit(0.0)), p, horizon).alias("_psi"))
    spread = F.aggregate("_psi", F.array(F.lit(0.0)), lambda acc, w: F.concat(acc, F.array(F.element_at(acc, -1) + w * w)))
    x = x.select(*keys, "_t", "sigma", F.posexplode(F.arrays_zip("_f", F.slice(spread, 2, horizon).alias("_s"))).alias("_i", "_x"))
    band = z * F.col("sigma") * F.sqrt(F.col("_x._s"))
    return x.select(*keys, (F.col("_i") + 1).alias("h"), F.date_add("_t", F.col("_i") + 1).alias(t), F.col("_x._f").alias("forecast"),
                    (F.col("_x._f") - band).alias("lower"), (F.col("_x._f") + band).alias("upper"))


# --- ARMA -----------------------------------------------------------------------------------------------

def _long_residuals(df: DataFrame, keys: list[str], t: str, v: str, order: int) -> DataFrame:
    """keys, t, the centred value ``_y`` and the residual ``_e`` of an autoregression of ``order``, written once."""
    x = _lags(_centred(df, keys, t, v).select(*keys, t, "_y"), keys, t, "_y", "_x", order)
    cols = ["_y", *[f"_x{i}" for i in range(1, order + 1)]]

    def solve(batches):
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                m = _square(row.sums, order + 2)
                fit = _least_squares(m, 1, [0, *range(2, order + 2)]) if m[0, 0] > order + 1 else None
                if fit is not None:
                    out.append((*tuple(row)[:len(keys)], fit[0].tolist()))
            yield pd.DataFrame(out, columns=[*keys, "_b"])

    fits = moments(x, keys, cols).mapInPandas(solve, f"{_key_fields(df, keys)}, _b array<double>")
    e = F.col("_y") - F.element_at("_b", 1)
    for i in range(1, order + 1):
        e = e - F.element_at("_b", i + 1) * F.col(f"_x{i}")
    return materialize(x.join(fits, keys).select(*keys, t, "_y", e.alias("_e")), "arma-residuals")


def _arma_rows(df: DataFrame, keys: list[str], t: str, v: str, p: int, q: int, long_order: int) -> DataFrame:
    """Centred values with p lags and q lags of the residuals of a long autoregression."""
    return _lags(_lags(_long_residuals(df, keys, t, v, long_order), keys, t, "_y", "y", p), keys, t, "_e", "e", q)


def arma_table(df: DataFrame, keys: list[str], t: str, v: str, max_p: int = 3, max_q: int = 3, long_order: int = 20) -> DataFrame:
    """Every order (p, q) up to the greatest, by two-stage least squares on one sample: keys, p, q, n, intercept, phi, theta, sigma, aic.

    Stage one: residuals of an autoregression of ``long_order``; stage two: the value on its own lags and the residuals' lags.
    All orders are nested in one matrix of products a series.  Singular systems have nulls.  Deviates from
    likelihood estimation: no starting values are searched for, and the AIC counts the conditional errors.
    """
    cols = ["_y", *[f"y{i}" for i in range(1, max_p + 1)], *[f"e{i}" for i in range(1, max_q + 1)]]
    rows = _arma_rows(df, keys, t, v, max_p, max_q, long_order)
    made = moments(rows, keys, cols).join(df.groupBy(*keys).agg(F.avg(v).alias("mean")), keys)

    def solve(batches):
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                m, key = _square(row.sums, len(cols) + 1), tuple(row)[:len(keys)]
                out += [(*key, p, q, *_arma_fit(m, p, q, max_p, row.mean)) for p in range(max_p + 1) for q in range(max_q + 1)]
            yield pd.DataFrame(out, columns=[*keys, *ORDER])

    return made.select(*keys, "sums", "mean").mapInPandas(solve, f"{_key_fields(df, keys)}, p int, q int, n long, intercept double, phi array<double>, theta array<double>, sigma double, aic double").withColumns(
        {c: nan_to_null(c) for c in ("intercept", "sigma", "aic")})


ORDER = ["p", "q", "n", "intercept", "phi", "theta", "sigma", "aic"]


def _arma_fit(m: np.ndarray, p: int, q: int, max_p: int, mean: float) -> tuple:
    n, k = int(round(m[0, 0])), p + q + 1
    fit = _least_squares(m, 1, [0, *range(2, 2 + p), *range(2 + max_p, 2 + max_p + q)]) if n > k else None
    if fit is None or fit[1] <= 0:
        return n, math.nan, None, None, math.nan, math.nan
    beta, error, _ = fit
    return n, float(beta[0] + mean * (1 - beta[1:1 + p].sum())), beta[1:1 + p].tolist(), beta[1 + p:].tolist(), math.sqrt(error / (n - k)), n * math.log(error / n) + 2 * k


def arma_search(df: DataFrame, keys: list[str], t: str, v: str, max_p: int = 3, max_q: int = 3, long_order: int = 20) -> DataFrame:
    """The order of least AIC of every series (of equal ones the smaller), with its coefficients."""
    table = arma_table(df, keys, t, v, max_p, max_q, long_order).where(F.col("aic").isNotNull())
    best = table.groupBy(*keys).agg(F.min_by(F.struct(*ORDER), F.struct("aic", "p", "q")).alias("b"))
    return best.select(*keys, "b.*")


def arma_walk_forward(df: DataFrame, coefs: DataFrame, keys: list[str], t: str, v: str, split_col: str = "split", lo: float = 0.0, hi: float = 500.0, z: float = Z95) -> DataFrame:
    """One-step forecasts of the ``test`` rows from the true history, with a band: keys, t, y, yhat, lower, upper.

    ``coefs`` has a row a series (keys, intercept, phi, theta, sigma).  The innovations are found by going through each
    series in order; before p values are there, and where a value is missing, the innovation is 0.
    """
    rows = df.select(*keys, t, F.col(v).cast("double").alias(v), split_col).join(coefs.select(*keys, "intercept", "phi", "theta", "sigma"), keys)
    rows = rows.repartition(*keys).sortWithinPartitions(*keys, t)

    def run(batches):
        now, values, shocks = object(), [], []
        for pdf in batches:
            keep, out = [], []
            for i, row in enumerate(zip(pdf[keys].itertuples(index=False, name=None), pdf[v], pdf[split_col], pdf["intercept"], pdf["phi"], pdf["theta"], strict=True)):
                key, y, split, c, phi, theta = row
                if key != now:
                    now, values, shocks = key, [], [0.0] * len(theta)  # newest first
                ready = len(values) == len(phi) and not any(math.isnan(x) for x in values)
                point = c + sum(a * b for a, b in zip(phi, values, strict=False)) + sum(a * b for a, b in zip(theta, shocks, strict=True)) if ready else math.nan
                shock = y - point if ready and not math.isnan(y) else 0.0
                values, shocks = [y, *values][:len(phi)], [shock, *shocks][:len(theta)]
                if split == "test":
                    keep.append(i)
                    out.append(point)
            if keep:
                made = pdf.iloc[keep][[*keys, t, v, "sigma"]].copy()
                made["point"] = out
                yield made

    types = dict(rows.dtypes)
    found = rows.mapInPandas(run, ", ".join(f"`{c}` {types[c]}" for c in [*keys, t, v, "sigma"]) + ", point double").withColumn("point", nan_to_null("point"))
    return found.select(*keys, t, F.col(v).alias("y"), clip("point", lo, hi).alias("yhat"), (F.col("point") - z * F.col("sigma")).alias("lower"), (F.col("point") + z * F.col("sigma")).alias("upper"))
