"""Profiles and statistics per series.

Quantiles are the exact, linearly interpolated kind (``percentile``), i.e. the
same definition as pandas/NumPy defaults.  ``percentile`` keeps a value->count
map per group and merges partial maps, so its memory is bounded by the number
of *distinct* values of one series.  Whole columns take theirs from
:mod:`panelstack.operators.quantiles`.  Pass ``exact=False`` for ``percentile_approx``.

Pearson correlation is computed as covar_pop / (stddev_pop * stddev_pop) with
``try_divide``: the built-in ``corr`` raises under ANSI mode on a constant column.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelstack.functions.bands import BAND_LABELS, aqi_band, aqi_band_code, nan_to_null
from panelstack.functions.bands import clip as clip_col
from panelstack.operators.quantiles import OrderStatistics, order_statistics


def quantiles(c: Column, probs: list[float], exact: bool = True) -> Column:
    if exact:
        return F.percentile(c, probs)
    return F.percentile_approx(c, probs, 1_000_000)


def to_long(df: DataFrame, keys: list[str], cols: list[str], name: str = "column", value: str = "value") -> DataFrame:
    """Wide measures -> (keys, column, value) with NaN -> null."""
    return df.select(*keys, *[nan_to_null(c).cast("double").alias(c) for c in cols]).unpivot(keys, cols, name, value)


def by_column(wide: DataFrame, keys: list[str], cols: list[str], fields: list[str]) -> DataFrame:
    """One row a column from an aggregate that has ``_<i>_<field>`` for the i-th column (rows are multiplied after the aggregate, not before)."""
    return wide.select(*keys, F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), *[F.col(f"_{i}_{f}").alias(f) for f in fields]) for i, c in enumerate(cols)])))


def describe(df: DataFrame, keys: list[str], cols: list[str], exact: bool = True) -> DataFrame:
    """count, mean, sample std, min, Q1, median, Q3, max per (series, column)."""
    aggs = []
    for i, c in enumerate(cols):
        v = nan_to_null(c).cast("double")
        aggs += [F.count(v).alias(f"_{i}_count"), F.avg(v).alias(f"_{i}_mean"), F.stddev_samp(v).alias(f"_{i}_std"),
                 F.min(v).alias(f"_{i}_min"), quantiles(v, [0.25, 0.5, 0.75], exact).alias(f"_{i}__q"), F.max(v).alias(f"_{i}_max")]
    agg = by_column(df.groupBy(*keys).agg(*aggs), keys, cols, ["count", "mean", "std", "min", "_q", "max"])
    return agg.select(*keys, "column", "count", "mean", "std", "min",
                      F.col("_q")[0].alias("q1"), F.col("_q")[1].alias("median"), F.col("_q")[2].alias("q3"), "max")


def kpis(df: DataFrame, keys: list[str], t: str, v: str) -> DataFrame:
    """Headline numbers per series in a single aggregate."""
    x = nan_to_null(v)
    d = F.unix_date(F.to_date(F.col(t)))
    present = x.isNotNull()
    g = df.groupBy(*keys).agg(
        F.avg(x).alias("mean_value"),
        F.max(x).alias("max_value"),
        F.max_by(F.col(t), F.when(present, F.struct(x, -d))).alias("max_date"),
        F.min(x).alias("min_value"),
        F.min_by(F.col(t), F.when(present, F.struct(x, d))).alias("min_date"),
        F.count_if(x > 100).alias("days_above_100"),
        (F.avg(F.when(present, F.when(x > 100, 1.0).otherwise(0.0))) * 100).alias("pct_above_100"),
        F.count_if(x <= 50).alias("days_at_most_50"),
        (F.avg(F.when(present, F.when(x <= 50, 1.0).otherwise(0.0))) * 100).alias("pct_at_most_50"),
        F.count(F.lit(1)).alias("n_days"),
        F.min(t).alias("first_date"), F.max(t).alias("last_date"))
    return g.withColumn("mean_band", aqi_band("mean_value"))


def monthly_by_year(df, keys, t, v, years: list[int] | None = None) -> DataFrame:
    """Mean by (year, month); ``years`` restricts the years (the filter is applied before aggregating)."""
    d = F.to_date(F.col(t))
    if years:
        df = df.where(F.year(d).isin(years))
    return df.groupBy(*keys, F.year(d).alias("year"), F.month(d).alias("month")).agg(
        F.avg(nan_to_null(v)).alias("mean_value"))


def month_profile(df, keys, t, v) -> DataFrame:
    x = nan_to_null(v)
    return df.groupBy(*keys, F.month(F.to_date(F.col(t))).alias("month")).agg(
        F.avg(x).alias("mean_value"), F.stddev_samp(x).alias("std_value"),
        F.max(x).alias("max_value"), F.min(x).alias("min_value"))


def weekday_profile(df, keys, t, v) -> DataFrame:
    return df.groupBy(*keys, F.weekday(F.to_date(F.col(t))).alias("weekday")).agg(
        F.avg(nan_to_null(v)).alias("mean_value"))


def band_distribution(df: DataFrame, keys: list[str], v: str) -> DataFrame:
    """Rows and share per band, zero-filled for absent bands, one row per (series, band).

    One aggregate computes all six counts (no join with a band table, no cross
    product of keys x bands), then an inline unpivot emits the six rows.
    """
    code = aqi_band_code(v)
    g = df.groupBy(*keys).agg(F.count(code).alias("_total"),
                              *[F.count_if(code == i).alias(f"_c{i}") for i in range(len(BAND_LABELS))])
    rows = F.inline(F.array(*[F.struct(F.lit(i).alias("band_code"), F.lit(lab).alias("band"),
                                       F.col(f"_c{i}").alias("n_days")) for i, lab in enumerate(BAND_LABELS)]))
    out = g.select(*keys, "_total", rows)
    return out.withColumn("pct", F.try_divide(F.col("n_days") * 100.0, F.col("_total"))).drop("_total")


def box_stats(df: DataFrame, keys: list[str], by: Column | str, v: str, name: str = "group",
              exact: bool = True) -> DataFrame:
    """Q1/median/Q3/mean, 1.5 IQR whiskers and outlier count per (series, group).

    Quartiles are a partial-combined aggregate per (keys, group); the small
    quartile table is joined back on (keys, group) (AQE broadcasts it when it
    is small, or splits skewed partitions of a sort-merge join), then a second
    aggregate counts whiskers and outliers.  No task ever buffers a whole group.
    """
    g = F.col(by) if isinstance(by, str) else by
    base = df.select(*keys, g.alias(name), nan_to_null(v).alias("_v")).where(F.col("_v").isNotNull())
    q = base.groupBy(*keys, name).agg(quantiles(F.col("_v"), [0.25, 0.5, 0.75], exact).alias("_q"),
                                      F.avg("_v").alias("mean"), F.count("_v").alias("n"))
    q = q.select(*keys, name, F.col("_q")[0].alias("q1"), F.col("_q")[1].alias("median"),
                 F.col("_q")[2].alias("q3"), "mean", "n")
    j = base.join(q, on=keys + [name])
    lo = F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))
    hi = F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))
    inside = (F.col("_v") >= lo) & (F.col("_v") <= hi)
    return j.groupBy(*keys, name, "q1", "median", "q3", "mean", "n").agg(
        F.min(F.when(inside, F.col("_v"))).alias("whisker_lo"), F.max(F.when(inside, F.col("_v"))).alias("whisker_hi"),
        F.count_if(~inside).alias("n_outliers"))


def histogram(df: DataFrame, keys: list[str], v: str, bins: int = 30) -> DataFrame:
    """Equal-width bins between each series' min and max (last bin closed), zero-filled.

    Bin of x = min(floor((x - min) * bins / (max - min)), bins - 1).  The per-series
    range is an aggregate joined back on the keys; counts per (series, bin) are
    partial-combined, then the at most ``bins`` entries per series are expanded to all bins.
    """
    base = df.select(*keys, nan_to_null(v).alias("_v")).where(F.col("_v").isNotNull())
    rng = base.groupBy(*keys).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    base = base.join(rng, on=keys)
    idx = F.least(F.floor(F.try_divide((F.col("_v") - F.col("_lo")) * F.lit(float(bins)),
                                       F.col("_hi") - F.col("_lo"))), F.lit(bins - 1))
    counted = (base.withColumn("bin", F.coalesce(idx, F.lit(0)).cast("int"))
               .groupBy(*keys, "_lo", "_hi", "bin").agg(F.count(F.lit(1)).alias("_n")))
    per = counted.groupBy(*keys, "_lo", "_hi").agg(F.map_from_entries(F.collect_list(F.struct("bin", "_n"))).alias("_m"))
    out = per.select(*keys, "_lo", "_hi", "_m", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    width = (F.col("_hi") - F.col("_lo")) / F.lit(float(bins))
    return out.select(*keys, "bin", (F.col("_lo") + F.col("bin") * width).alias("bin_lo"),
                      (F.col("_lo") + (F.col("bin") + 1) * width).alias("bin_hi"),
                      F.coalesce(F.try_element_at("_m", F.col("bin")), F.lit(0)).cast("long").alias("count"))


def banded_histogram(df: DataFrame, keys: list[str], v: str, edges=(0, 50, 100, 150, 250), width: float = 8.0):
    """Histogram with fixed-width bins inside [lo, hi) bands, bins anchored at each band start.

    The last band is open; values below the first edge have a null ``band_lo`` and
    bins anchored at that edge, so the counts add up to the non-null values.
    """
    x = nan_to_null(v)
    band = None
    for lo, hi in zip(edges, [*edges[1:], None]):
        cond = (x >= lo) if hi is None else (x >= lo) & (x < hi)
        band = F.when(cond, F.lit(float(lo))) if band is None else band.when(cond, F.lit(float(lo)))
    b = df.select(*keys, x.alias("_v"), band.alias("band_lo")).where(F.col("_v").isNotNull())
    anchor = F.coalesce("band_lo", F.lit(float(edges[0])))
    start = anchor + F.floor((F.col("_v") - anchor) / width) * width
    return b.groupBy(*keys, "band_lo", start.alias("bin_lo")).agg(F.count(F.lit(1)).alias("count"))


def expansion_terms(error: float) -> int:
    """Terms of the Hermite series of a Gaussian half a bandwidth around its centre, so that what is cut off stays below ``error``.

    A term is at most 1.09 * 0.5^k / sqrt(k!).
    """
    def rest(p: int) -> float:
        return sum(1.09 * 0.5**k / math.sqrt(math.factorial(k)) for k in range(p, p + 40))

    return next(p for p in range(1, 120) if rest(p) <= error)


def kde(df: DataFrame, keys: list[str], v: str, grid: int = 300, bins: int = 30, error: float = 1e-12) -> DataFrame:
    """Gaussian KDE (Scott bandwidth n^-1/5 * sample std) on ``grid`` points, scaled to histogram counts.

    Values are summed up in boxes one bandwidth wide, each box by its moments around its centre (one
    aggregate, combined map side), and the Gaussian sum is evaluated from the boxes' Hermite series: work grows
    with the values plus boxes x grid points near them, and no row is copied for a grid point.  A value's kernel is off by
    ``error`` at most (of its peak 1).  A series without spread (constant or a single value) has null densities.
    """
    x = nan_to_null(v)
    base = df.select(*keys, x.alias("_v")).where(F.col("_v").isNotNull())
    stats = base.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.stddev_samp("_v").alias("_sd"),
                                    F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    bw = F.col("_sd") * F.pow(F.col("_n").cast("double"), F.lit(-0.2))
    stats = stats.withColumns({"_bw": F.when(bw > 0, bw), "_step": (F.col("_hi") - F.col("_lo")) / F.lit(float(grid - 1))})
    terms, reach = expansion_terms(error), math.sqrt(-2 * math.log(error)) + 0.5
    t = (F.col("_v") - F.col("_lo")) / F.col("_bw")
    placed = base.join(stats.where(F.col("_bw").isNotNull()), on=keys).withColumn("_box", F.floor(t)).withColumn("_t", t - F.col("_box") - 0.5)
    own = ["_n", "_lo", "_hi", "_bw", "_step"]
    boxes = placed.groupBy(*keys, "_box", *own).agg(F.array(*[F.sum(F.pow("_t", F.lit(k)) / math.factorial(k)) for k in range(terms)]).alias("_m"))
    centre = F.col("_lo") + (F.col("_box") + 0.5) * F.col("_bw")
    first = F.greatest(F.lit(0), F.ceil((centre - reach * F.col("_bw") - F.col("_lo")) / F.col("_step")).cast("int"))
    last = F.least(F.lit(grid - 1), F.floor((centre + reach * F.col("_bw") - F.col("_lo")) / F.col("_step")).cast("int"))
    near = boxes.withColumns({"_c": centre, "grid_index": F.explode(F.when(first <= last, F.sequence(first, last)))})

    def point(j: Column) -> Column:
        return F.when(j == grid - 1, F.col("_hi")).otherwise(F.col("_lo") + j * F.col("_step"))

    near = near.withColumn("_u", (point(F.col("grid_index")) - F.col("_c")) / F.col("_bw"))
    # He(k + 1) = u He(k) - k He(k - 1), summed with the moments on the way.
    start = F.struct(F.lit(0.0).alias("before"), F.lit(1.0).alias("now"), F.lit(0.0).alias("k"), F.lit(0.0).alias("sum"))
    series = F.aggregate("_m", start, lambda a, m: F.struct(a["now"].alias("before"), (F.col("_u") * a["now"] - a["k"] * a["before"]).alias("now"),
                                                            (a["k"] + 1.0).alias("k"), (a["sum"] + m * a["now"]).alias("sum")), lambda a: a["sum"])
    sums = near.groupBy(*keys, "grid_index").agg(F.sum(F.exp(F.lit(-0.5) * F.col("_u") * F.col("_u")) * series).alias("_s"))
    points = stats.withColumn("grid_index", F.explode(F.sequence(F.lit(0), F.lit(grid - 1)))).withColumn("x", point(F.col("grid_index")))
    density = F.coalesce("_s", F.when(F.col("_bw").isNotNull(), 0.0)) / (F.col("_n") * F.col("_bw") * F.lit(math.sqrt(2 * math.pi)))
    return points.join(sums, [*keys, "grid_index"], "left").select(
        *keys, "grid_index", "x", (density * F.col("_n") * (F.col("_hi") - F.col("_lo")) / F.lit(float(bins))).alias("density_count"))


def pivot_mean(df: DataFrame, keys: list[str], rows: Column, cols: Column, values: list[int], v: str,
               row_name: str, prefix: str) -> DataFrame:
    """Mean of ``v`` by (row, column) as a wide table; the column values are given, so no extra distinct job."""
    p = (df.select(*keys, rows.alias(row_name), cols.alias("_pc"), nan_to_null(v).alias("_v"))
         .groupBy(*keys, row_name).pivot("_pc", values).agg(F.avg("_v")))
    return p.withColumnsRenamed({str(c): f"{prefix}{c:02d}" for c in values})


def pearson(a: Column, b: Column) -> Column:
    """Pairwise-complete Pearson r; null when either side is constant."""
    aa, bb = F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)
    return F.try_divide(F.covar_pop(aa, bb), F.stddev_pop(aa) * F.stddev_pop(bb))


def corr_matrix(df: DataFrame, keys: list[str], cols: list[str], lower_only: bool = False) -> DataFrame:
    """All column pairs in one aggregate pass, returned long: (keys, col_a, col_b, r).

    Each unordered pair is computed once and mirrored while unpivoting; the
    diagonal is 1 where the column varies.
    """
    x = {c: nan_to_null(c) for c in cols}
    lower = [(a, b) for i, a in enumerate(cols) for b in cols[:i]]
    aggs = [pearson(x[a], x[b]).alias(f"_r{i}") for i, (a, b) in enumerate(lower)]
    aggs += [F.when(F.stddev_pop(x[c]) > 0, F.lit(1.0)).alias(f"_d{i}") for i, c in enumerate(cols)]
    g = df.groupBy(*keys).agg(*aggs)
    cells = [(a, b, f"_r{i}") for i, (a, b) in enumerate(lower)]
    if not lower_only:
        cells += [(b, a, r) for a, b, r in cells] + [(c, c, f"_d{i}") for i, c in enumerate(cols)]
    rows = F.inline(F.array(*[F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), F.col(r).alias("r")) for a, b, r in cells]))
    return g.select(*keys, rows)


def top_correlated(df: DataFrame, keys: list[str], target: str, cols: list[str], k: int = 15) -> DataFrame:
    """The k columns with the largest |r| to the target: one aggregate of len(cols) pairs."""
    others = [c for c in cols if c != target]
    g = df.groupBy(*keys).agg(*[pearson(nan_to_null(target), nan_to_null(c)).alias(f"_r{i}") for i, c in enumerate(others)])
    cm = g.select(*keys, F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"_r{i}").alias("r")) for i, c in enumerate(others)])))
    w = Window.partitionBy(*keys).orderBy(F.abs(F.col("r")).desc_nulls_last(), F.col("feature"))
    return cm.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(*keys, "feature", "r", "rank")


def linear_trend(df: DataFrame, keys: list[str], xcol: str, ycol: str, grid: int = 100) -> DataFrame:
    """Least-squares line y = a + b x, r, and the line evaluated on ``grid`` points from min(x) to max(x)."""
    x, y = nan_to_null(xcol), nan_to_null(ycol)
    both = x.isNotNull() & y.isNotNull()
    g = df.groupBy(*keys).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"),
                              pearson(x, y).alias("r"), F.regr_count(y, x).alias("n"),
                              F.min(F.when(both, x)).alias("_lo"), F.max(F.when(both, x)).alias("_hi"))
    pts = g.withColumn("grid_index", F.explode(F.sequence(F.lit(0), F.lit(grid - 1))))
    step = (F.col("_hi") - F.col("_lo")) / F.lit(float(grid - 1))
    gx = F.when(F.col("grid_index") == grid - 1, F.col("_hi")).otherwise(F.col("_lo") + F.col("grid_index") * step)
    return pts.select(*keys, "slope", "intercept", "r", "n", "grid_index", gx.alias("x"),
                      (F.col("intercept") + F.col("slope") * gx).alias("y_fit"))


def skew_std(df: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """Bias-corrected sample skewness G1 = g1*sqrt(n(n-1))/(n-2) and sample std per column."""
    aggs = []
    for i, c in enumerate(cols):
        v = nan_to_null(c).cast("double")
        aggs += [F.count(v).alias(f"_{i}_n"), F.stddev_samp(v).alias(f"_{i}_std"), F.skewness(v).alias(f"_{i}_g1")]
    n = F.col("n").cast("double")
    return (by_column(df.groupBy(*keys).agg(*aggs), keys, cols, ["n", "std", "g1"])
            .select(*keys, "column", "n", "std", (F.col("g1") * F.sqrt(n * (n - 1)) / F.when(n > 2, n - 2)).alias("skew")))


def outlier_summary(df: DataFrame, keys: list[str], cols: list[str], exact: bool = True) -> DataFrame:
    """Counts and % outside 1.5*IQR and 3*IQR fences, per (series, column); columns without values are left out.

    Quartiles: one partial-combined aggregate per series over all columns, joined back on
    the keys; the counting is a second aggregate, and the columns become rows last.
    """
    base = df.select(*keys, *[nan_to_null(c).cast("double").alias(f"_v{i}") for i, c in enumerate(cols)])
    q = base.groupBy(*keys).agg(*[quantiles(F.col(f"_v{i}"), [0.25, 0.75], exact).alias(f"_q{i}") for i in range(len(cols))])
    aggs = []
    for i in range(len(cols)):
        v, q1, q3 = F.col(f"_v{i}"), F.col(f"_q{i}")[0], F.col(f"_q{i}")[1]
        iqr = q3 - q1
        aggs += [F.first(q1).alias(f"_{i}_q1"), F.first(q3).alias(f"_{i}_q3"), F.first(iqr).alias(f"_{i}_iqr"), F.count(v).alias(f"_{i}_n")]
        for name, k in (("1_5", 1.5), ("3", 3.0)):
            out = (v < q1 - k * iqr) | (v > q3 + k * iqr)
            aggs += [F.count_if(out).alias(f"_{i}_n_out_{name}"), (F.avg(out.cast("double")) * 100).alias(f"_{i}_pct_out_{name}")]
    fields = ["q1", "q3", "iqr", "n", "n_out_1_5", "pct_out_1_5", "n_out_3", "pct_out_3"]
    return by_column(base.join(q, on=keys).groupBy(*keys).agg(*aggs), keys, cols, fields).where(F.col("n") > 0)


# --- fitted transforms -------------------------------------------------------------------------

@dataclass
class Fences:
    """Winsorizing fences fitted on training rows: [max(Q1-3IQR, floor), Q3+3IQR] per column."""
    bounds: dict[str, tuple[float | None, float | None]]

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: nan_to_null(c) if lo is None else clip_col(c, lo, hi) for c, (lo, hi) in self.bounds.items()})


@dataclass
class RobustScaler:
    """(x - median) / IQR with parameters fitted on training rows; IQR 0 -> divide by 1; no training values -> null."""
    params: dict[str, tuple[float | None, float]]

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: (nan_to_null(c) - F.lit(m).cast("double")) / F.lit(s) for c, (m, s) in self.params.items()})


def fences_of(stats: OrderStatistics, cols: list[str], k: float = 3.0, floor: float | None = 0.0) -> Fences:
    bounds = {}
    for c in cols:
        q1, q3 = stats.quantile(c, 0.25), stats.quantile(c, 0.75)
        if q1 is None:  # a column without values has no fences
            bounds[c] = (None, None)
            continue
        lo = q1 - k * (q3 - q1)
        bounds[c] = (max(lo, floor) if floor is not None else lo, q3 + k * (q3 - q1))
    return Fences(bounds)


def scaler_of(stats: OrderStatistics, cols: list[str], fences: Fences | None = None) -> RobustScaler:
    """Median and IQR of the columns as they are after the fences (clipping keeps the order, so the same pass serves)."""
    params = {}
    for c in cols:
        lo, hi = (fences.bounds.get(c) if fences else None) or (None, None)
        q1, med, q3 = (stats.quantile(c, p, lambda x, lo=lo, hi=hi: x if lo is None else min(max(x, lo), hi)) for p in (0.25, 0.5, 0.75))
        params[c] = (None, 1.0) if med is None else (med, (q3 - q1) or 1.0)
    return RobustScaler(params)


def fit_fences(train: DataFrame, cols: list[str], k: float = 3.0, floor: float | None = 0.0) -> Fences:
    return fences_of(order_statistics(train, cols, [0.25, 0.75]), cols, k, floor)


def fit_robust_scaler(train: DataFrame, cols: list[str]) -> RobustScaler:
    return scaler_of(order_statistics(train, cols, [0.25, 0.5, 0.75]), cols)


def scale_check(df: DataFrame, cols: list[str]) -> DataFrame:
    """Mean and exact median of each column, 3 decimals (one row a column)."""
    medians = order_statistics(df, cols, [0.5])
    means = to_long(df, [], cols).groupBy("column").agg(F.round(F.avg("value"), 3).alias("mean"))
    rows = df.sparkSession.createDataFrame([(c, medians.quantile(c, 0.5)) for c in cols], "column string, median double")
    return means.join(rows, "column").select("column", "mean", F.round("median", 3).alias("median"))
