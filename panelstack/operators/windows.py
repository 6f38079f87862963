"""Ordered operators over each series.

All feature columns built by :func:`window_features` share one
``partitionBy(keys).orderBy(t)`` spec and are added in a single projection, so
Catalyst plans one exchange, one sort and one Window node for every lag,
rolling statistic and difference (asserted in the tests).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def series_window(keys: list[str], t: str):
    return Window.partitionBy(*keys).orderBy(t)


def lag_columns(keys, t, v, lags=(1, 2, 3, 7, 14), prefix="lag_") -> dict[str, Column]:
    w = series_window(keys, t)
    return {f"{prefix}{k}": F.lag(F.col(v), k).over(w) for k in lags}


def calendar_lag_columns(keys, t, v, lags=(1, 2, 3, 7, 14), prefix="lag_") -> dict[str, Column]:
    """Lag by calendar days, correct on a grid with gaps: frame ``rangeBetween(-k, -k)`` over the day number."""
    w = Window.partitionBy(*keys).orderBy(F.unix_date(F.col(t)))
    return {f"{prefix}{k}": F.max(F.col(v)).over(w.rangeBetween(-k, -k)) for k in lags}


def rolling_columns(keys, t, v, windows=(3, 7, 14, 30), funcs=("mean", "std", "max", "min")) -> dict[str, Column]:
    """Statistic over the previous ``w`` rows (today excluded); null unless all ``w`` values are present."""
    w = series_window(keys, t)
    fn = {"mean": F.avg, "std": F.stddev_samp, "max": F.max, "min": F.min, "sum": F.sum}
    out = {}
    for n in windows:
        frame = w.rowsBetween(-n, -1)
        full = F.count(F.col(v)).over(frame) == n
        for f in funcs:
            out[f"rolling_{f}_{n}"] = F.when(full, fn[f](F.col(v)).over(frame))
    return out


def diff_columns(keys, t, v, periods=(1, 7)) -> dict[str, Column]:
    w = series_window(keys, t)
    return {f"diff_{k}": F.col(v) - F.lag(F.col(v), k).over(w) for k in periods}


def lag_features(df, keys, t, v, lags=(1, 2, 3, 7, 14), calendar: bool = False) -> DataFrame:
    cols = calendar_lag_columns(keys, t, v, lags) if calendar else lag_columns(keys, t, v, lags)
    return df.withColumns(cols)


def lead_target(df, keys, t, v, k: int = 1, name: str = "target") -> DataFrame:
    return df.withColumn(name, F.lead(F.col(v), k).over(series_window(keys, t)))


def rolling_features(df, keys, t, v, windows=(3, 7, 14, 30), funcs=("mean", "std", "max", "min")) -> DataFrame:
    return df.withColumns(rolling_columns(keys, t, v, windows, funcs))


def diff_features(df, keys, t, v, periods=(1, 7)) -> DataFrame:
    return df.withColumns(diff_columns(keys, t, v, periods))


def window_features(df, keys, t, v, lags=(1, 2, 3, 7, 14), windows=(3, 7, 14, 30),
                    funcs=("mean", "std", "max", "min"), diffs=(1, 7), lead: int | None = 1,
                    target: str = "target_reg_tomorrow") -> DataFrame:
    """Lags, shifted rolling stats, differences and the lead target in one projection."""
    cols = {}
    cols.update(lag_columns(keys, t, v, lags))
    cols.update(rolling_columns(keys, t, v, windows, funcs))
    cols.update(diff_columns(keys, t, v, diffs))
    if lead:
        cols[target] = F.lead(F.col(v), lead).over(series_window(keys, t))
    return df.withColumns(cols)


def trailing_mean(df, keys, t, v, windows=(7, 30)) -> DataFrame:
    """Mean of the last ``w`` rows including today, over whatever values are present (min_periods=1)."""
    w = series_window(keys, t)
    return df.withColumns({f"trailing_mean_{n}": F.avg(F.col(v)).over(w.rowsBetween(-(n - 1), 0)) for n in windows})


def centered_mean(df, keys, t, v, windows=(7, 30)) -> DataFrame:
    """Centred mean, frame ``[-w//2, (w-1)//2]``; null unless the full window has values."""
    w = series_window(keys, t)
    out = {}
    for n in windows:
        frame = w.rowsBetween(-(n // 2), (n - 1) // 2)
        out[f"centered_mean_{n}"] = F.when(F.count(F.col(v)).over(frame) == n, F.avg(F.col(v)).over(frame))
    return df.withColumns(out)


def extremes(df, keys, t, v) -> DataFrame:
    """Max and min with their dates; ties go to the earliest date."""
    d = F.unix_date(F.to_date(F.col(t)))
    x = F.col(v)
    present = x.isNotNull() & ~F.isnan(x)
    return df.where(present).groupBy(*keys).agg(
        F.max(x).alias("max_value"),
        F.max_by(F.col(t), F.struct(x, -d)).alias("max_date"),
        F.min(x).alias("min_value"),
        F.min_by(F.col(t), F.struct(x, d)).alias("min_date"),
    )


def latest_row(df, keys, t) -> DataFrame:
    """Newest row per series, as an aggregate (no sort of the whole series)."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*df.columns), F.col(t)).alias("_r")).select("_r.*")


def last_n(df, keys, t, n: int = 10) -> DataFrame:
    """The ``n`` newest rows per series (top-k per group; the limit is the feature)."""
    w = Window.partitionBy(*keys).orderBy(F.col(t).desc())
    return df.withColumn("recency_rank", F.row_number().over(w)).where(F.col("recency_rank") <= n)


def time_split(df, keys, t, test_fraction: float = 0.2) -> DataFrame:
    """Per series, the last ceil(fraction*n) rows are ``test``, the rest ``train`` (no shuffle of rows)."""
    w = series_window(keys, t)
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    rn = F.row_number().over(w)
    n_test = F.ceil(n * F.lit(test_fraction))
    return df.withColumn("split", F.when(rn > n - n_test, F.lit("test")).otherwise(F.lit("train")))


def time_series_folds(df, keys, t, k: int = 5) -> DataFrame:
    """Expanding-window folds: test size n // (k+1); fold i tests rows [s_i, s_i + size), trains on [0, s_i).

    Emits each row once per fold it takes part in with a ``role`` column
    (train/test), i.e. at most ``k`` copies of a row.
    """
    w = series_window(keys, t)
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    size = F.floor(n / F.lit(k + 1))
    base = df.withColumns({"_rn": F.row_number().over(w) - 1, "_size": size, "_n": n})
    first = F.col("_n") - F.lit(k) * F.col("_size")
    folds = F.sequence(F.lit(0), F.lit(k - 1))
    ex = base.withColumn("fold", F.explode(folds))
    start = first + F.col("fold") * F.col("_size")
    role = (F.when(F.col("_rn") < start, F.lit("train"))
            .when(F.col("_rn") < start + F.col("_size"), F.lit("test")))
    return ex.withColumn("role", role).where(F.col("role").isNotNull()).drop("_rn", "_size", "_n")


def ordered_sample(df, keys, v, k: int = 360) -> DataFrame:
    """``k`` evenly spaced order statistics of ``v`` per series (positions int(j*(n-1)/(k-1))).

    The wanted positions are generated per series (k rows each) and equi-joined
    to the ranked rows, so no row carries the full position list.
    """
    w = Window.partitionBy(*keys).orderBy(F.col(v))
    x = df.where(F.col(v).isNotNull() & ~F.isnan(F.col(v)))
    ranked = x.select(*keys, F.col(v).alias("sample_value"), (F.row_number().over(w) - 1).alias("position"))
    counts = x.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    step = (F.col("_n") - 1).cast("double") / F.lit(float(k - 1))
    j = F.col("j")
    wanted = (counts.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
              .withColumn("position", F.when(j == k - 1, F.col("_n") - 1)
                          .otherwise(F.floor(j.cast("double") * step)).cast("int"))
              .select(*keys, "j", "position"))
    return wanted.join(ranked, on=keys + ["position"], how="inner").select(*keys, "j", "position", "sample_value")
