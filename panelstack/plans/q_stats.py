"""Aggregations and statistics (E), metrics over deterministic baseline forecasts, leaderboards (F)."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelstack.functions.bands import aqi_class
from panelstack.functions.calendar import percent_label
from panelstack.operators.metrics import (
    balanced_weights, classification_metrics, confusion_matrix, coverage, cv_summary, error_by_month, fit_gap,
    regression_metrics, residual_histogram, residual_summary,
)
from panelstack.operators.ranking import leaderboard
from panelstack.operators.stats import (
    band_distribution, banded_histogram, box_stats, corr_matrix, describe, fit_fences, fit_robust_scaler, histogram,
    kde, kpis, linear_trend, month_profile, monthly_by_year, outlier_summary, pivot_mean, scale_check, skew_std,
    top_correlated, weekday_profile,
)
from panelstack.operators.windows import lead_target, time_series_folds, time_split, trailing_mean
from panelstack.plans.panels import K, p2_filled
from panelstack.plans.q_series import RANK_FEATURES, SPLIT_SQL, _p3_with_lags, _sql_pearson
from panelstack.plans.registry import register
from panelstack.plans.sqlparts import BANDS, P2I, P3, W, aqi_class as sql_class, band_code, band_label, clip
from panelstack.sources.fixtures import P3_MEASURES, p3_measure_panel

T = "date"
P3_LONG = f"""{P3},
p3l AS (SELECT series_id, date, "column", value FROM (UNPIVOT p3 ON quantity, extendedprice, discount, tax
        INTO NAME "column" VALUE value))"""


@register("describe", f"""
WITH {P3_LONG}
SELECT series_id, "column", count(value) AS count, avg(value) AS mean, stddev_samp(value) AS std, min(value) AS min,
quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3, max(value) AS max
FROM p3l GROUP BY 1, 2""", doubles="mean std min q1 median q3 max")
def q_describe(spark, sf_dir):
    return describe(p3_measure_panel(spark, sf_dir), K, P3_MEASURES)


@register("kpis", f"""
WITH {P2I},
a AS (SELECT series_id, avg(value) AS mean_value, max(value) AS max_value, min(value) AS min_value,
      count_if(value > 100) AS days_above_100, avg(CASE WHEN value > 100 THEN 1.0 ELSE 0.0 END) * 100 AS pct_above_100,
      count_if(value <= 50) AS days_at_most_50, avg(CASE WHEN value <= 50 THEN 1.0 ELSE 0.0 END) * 100 AS pct_at_most_50,
      count(*) AS n_days, min(date) AS first_date, max(date) AS last_date FROM p2i GROUP BY 1)
SELECT a.*, {band_label('a.mean_value')} AS mean_band,
  (SELECT min(date) FROM p2i WHERE p2i.series_id = a.series_id AND p2i.value = a.max_value) AS max_date,
  (SELECT min(date) FROM p2i WHERE p2i.series_id = a.series_id AND p2i.value = a.min_value) AS min_date FROM a""",
          doubles="mean_value max_value min_value pct_above_100 pct_at_most_50", ints="days_above_100 days_at_most_50")
def q_kpis(spark, sf_dir):
    return kpis(p2_filled(spark, sf_dir), K, T, "value")


@register("monthly_by_year", f"WITH {P2I} SELECT series_id, year(date) AS year, month(date) AS month, "
          "avg(value) AS mean_value FROM p2i GROUP BY 1, 2, 3", doubles="mean_value", ints="year month")
def q_monthly_by_year(spark, sf_dir):
    return monthly_by_year(p2_filled(spark, sf_dir), K, T, "value")


@register("month_profile", f"WITH {P2I} SELECT series_id, month(date) AS month, avg(value) AS mean_value, "
          "stddev_samp(value) AS std_value, max(value) AS max_value, min(value) AS min_value FROM p2i GROUP BY 1, 2",
          doubles="mean_value std_value max_value min_value", ints="month")
def q_month_profile(spark, sf_dir):
    return month_profile(p2_filled(spark, sf_dir), K, T, "value")


@register("weekday_profile", f"WITH {P2I} SELECT series_id, isodow(date) - 1 AS weekday, avg(value) AS mean_value "
          "FROM p2i GROUP BY 1, 2", doubles="mean_value", ints="weekday")
def q_weekday_profile(spark, sf_dir):
    return weekday_profile(p2_filled(spark, sf_dir), K, T, "value")


@register("band_distribution", f"""
WITH {P2I}, {BANDS},
c AS (SELECT series_id, {band_code('value')} AS band_code, count(*) AS n FROM p2i WHERE value IS NOT NULL GROUP BY 1, 2),
t AS (SELECT series_id, count(value) AS total FROM p2i GROUP BY 1)
SELECT t.series_id, b.band_code, b.band, coalesce(c.n, 0) AS n_days, coalesce(c.n, 0) * 100.0 / t.total AS pct
FROM t CROSS JOIN bands b LEFT JOIN c ON c.series_id = t.series_id AND c.band_code = b.band_code""",
          doubles="pct", ints="band_code n_days")
def q_band_distribution(spark, sf_dir):
    return band_distribution(p2_filled(spark, sf_dir), K, "value")


@register("band_legend", f"""
WITH {P2I}, {BANDS},
c AS (SELECT series_id, {band_code('value')} AS band_code, count(*) AS n FROM p2i WHERE value IS NOT NULL GROUP BY 1, 2),
t AS (SELECT series_id, count(value) AS total FROM p2i GROUP BY 1),
d AS (SELECT t.series_id, b.band_code, b.band, coalesce(c.n, 0) * 100.0 / t.total AS pct
      FROM t CROSS JOIN bands b LEFT JOIN c ON c.series_id = t.series_id AND c.band_code = b.band_code)
SELECT series_id, band_code, printf('%s (%.2f%%)', band, floor(pct * 100.0 + 0.5) / 100.0) AS legend FROM d""",
          ints="band_code")
def q_band_legend(spark, sf_dir):
    d = band_distribution(p2_filled(spark, sf_dir), K, "value")
    return d.select("series_id", "band_code", percent_label("band", "pct").alias("legend"))


@register("box_stats", f"""
WITH {P2I},
q AS (SELECT series_id, month(date) AS "group", quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median,
      quantile_cont(value, 0.75) AS q3, avg(value) AS mean, count(value) AS n FROM p2i GROUP BY 1, 2),
j AS (SELECT p.value, q.*, p.value >= q.q1 - 1.5 * (q.q3 - q.q1) AND p.value <= q.q3 + 1.5 * (q.q3 - q.q1) AS inside
      FROM p2i p JOIN q ON p.series_id = q.series_id AND month(p.date) = q."group")
SELECT series_id, "group", q1, median, q3, mean, min(value) FILTER (WHERE inside) AS whisker_lo,
max(value) FILTER (WHERE inside) AS whisker_hi, count_if(NOT inside) AS n_outliers, n
FROM j GROUP BY series_id, "group", q1, median, q3, mean, n""",
          doubles="q1 median q3 mean whisker_lo whisker_hi", ints="group n_outliers")
def q_box_stats(spark, sf_dir):
    return box_stats(p2_filled(spark, sf_dir), K, F.month(T), "value")


def _hist_sql(src_ctes: str, src: str, col: str, bins: int, keys: str = "series_id") -> str:
    return f"""
WITH {src_ctes},
b AS (SELECT {keys}, {col} AS v, min({col}) OVER (PARTITION BY {keys}) AS lo, max({col}) OVER (PARTITION BY {keys}) AS hi
      FROM {src} WHERE {col} IS NOT NULL),
c AS (SELECT {keys}, lo, hi, coalesce(least(CAST(floor(CASE WHEN hi - lo <> 0 THEN (v - lo) * {float(bins)} / (hi - lo) END)
      AS BIGINT), {bins - 1}), 0) AS bin, count(*) AS n FROM b GROUP BY ALL),
k AS (SELECT DISTINCT {keys}, lo, hi FROM c)
SELECT k.{keys}, t.bin, k.lo + t.bin * ((k.hi - k.lo) / {float(bins)}) AS bin_lo,
       k.lo + (t.bin + 1) * ((k.hi - k.lo) / {float(bins)}) AS bin_hi, coalesce(c.n, 0) AS count
FROM k CROSS JOIN range(0, {bins}) t(bin) LEFT JOIN c ON c.{keys} = k.{keys} AND c.bin = t.bin"""


@register("histogram_30", _hist_sql(P2I, "p2i", "value", 30), doubles="bin_lo bin_hi", ints="bin count")
def q_histogram_30(spark, sf_dir):
    return histogram(p2_filled(spark, sf_dir), K, "value", 30)


@register("banded_histogram", f"""
WITH {P2I},
b AS (SELECT series_id, value, CASE WHEN value >= 250 THEN 250.0 WHEN value >= 150 THEN 150.0 WHEN value >= 100 THEN 100.0
      WHEN value >= 50 THEN 50.0 WHEN value >= 0 THEN 0.0 END AS band_lo FROM p2i)
SELECT series_id, band_lo, coalesce(band_lo, 0.0) + floor((value - coalesce(band_lo, 0.0)) / 8.0) * 8.0 AS bin_lo, count(*) AS count
FROM b WHERE value IS NOT NULL GROUP BY 1, 2, 3""", doubles="band_lo bin_lo")
def q_banded_histogram(spark, sf_dir):
    return banded_histogram(p2_filled(spark, sf_dir), K, "value")


@register("kde", f"""
WITH {P2I},
b AS (SELECT series_id, value FROM p2i WHERE value IS NOT NULL),
st AS (SELECT series_id, count(*) AS n, stddev_samp(value) AS sd, min(value) AS lo, max(value) AS hi FROM b GROUP BY 1),
d AS (SELECT series_id, value, count(*) AS w FROM b GROUP BY 1, 2),
g AS (SELECT st.*, t.gi, CASE WHEN t.gi = 299 THEN hi ELSE lo + t.gi * ((hi - lo) / 299.0) END AS x,
      sd * pow(CAST(n AS DOUBLE), -0.2) AS bw FROM st, range(0, 300) t(gi))
SELECT g.series_id, g.gi AS grid_index, g.x,
  sum(d.w * exp(-0.5 * ((g.x - d.value) / g.bw) * ((g.x - d.value) / g.bw))) / (g.n * g.bw * sqrt(2 * pi()))
  * g.n * (g.hi - g.lo) / 30.0 AS density_count
FROM g JOIN d ON d.series_id = g.series_id GROUP BY g.series_id, g.gi, g.x, g.n, g.bw, g.hi, g.lo""",
          doubles="x density_count", ints="grid_index")
def q_kde(spark, sf_dir):
    return kde(p2_filled(spark, sf_dir), K, "value", grid=300, bins=30)


def _pivot_sql(row_expr: str, row_name: str, col_expr: str, values: range, prefix: str) -> str:
    cols = ", ".join(f"avg(CASE WHEN {col_expr} = {v} THEN value END) AS {prefix}{v:02d}" for v in values)
    return f"WITH {P2I} SELECT series_id, {row_expr} AS {row_name}, {cols} FROM p2i GROUP BY 1, 2"


@register("pivot_month_day", _pivot_sql("month(date)", "month", "day(date)", range(1, 32), "d"),
          doubles=[f"d{v:02d}" for v in range(1, 32)], ints="month")
def q_pivot_month_day(spark, sf_dir):
    return pivot_mean(p2_filled(spark, sf_dir), K, F.month(T), F.dayofmonth(T), list(range(1, 32)), "value", "month", "d")


@register("pivot_dow_month", _pivot_sql("isodow(date) - 1", "weekday", "month(date)", range(1, 13), "m"),
          doubles=[f"m{v:02d}" for v in range(1, 13)], ints="weekday")
def q_pivot_dow_month(spark, sf_dir):
    return pivot_mean(p2_filled(spark, sf_dir), K, F.weekday(T), F.month(T), list(range(1, 13)), "value", "weekday", "m")


_CORR_PAIRS = " UNION ALL ".join(
    f"SELECT series_id, '{a}' AS col_a, '{b}' AS col_b, {_sql_pearson(a, b)} AS r FROM p3 GROUP BY 1"
    for a in P3_MEASURES for b in P3_MEASURES)


@register("corr_matrix", f"WITH {P3} {_CORR_PAIRS}", doubles="r")
def q_corr_matrix(spark, sf_dir):
    return corr_matrix(p3_measure_panel(spark, sf_dir), K, P3_MEASURES)


_TOPC = " UNION ALL ".join(
    f"SELECT series_id, '{c}' AS feature, {_sql_pearson('extendedprice', c)} AS r FROM p3l GROUP BY 1" for c in RANK_FEATURES)


@register("top_correlated", f"""
WITH {P3},
p3l AS (SELECT *, lag(quantity, 1) OVER ({W}) AS quantity_lag_1, lag(discount, 1) OVER ({W}) AS discount_lag_1,
        lag(tax, 1) OVER ({W}) AS tax_lag_1 FROM p3),
c AS ({_TOPC})
SELECT * FROM (SELECT series_id, feature, r, row_number() OVER (PARTITION BY series_id ORDER BY abs(r) DESC NULLS LAST, feature)
AS rank FROM c) WHERE rank <= 15""", doubles="r", ints="rank")
def q_top_correlated(spark, sf_dir):
    return top_correlated(_p3_with_lags(spark, sf_dir), K, "extendedprice", RANK_FEATURES, 15)


@register("linear_trend", f"""
WITH {P3},
g AS (SELECT series_id, regr_slope(extendedprice, quantity) AS slope, regr_intercept(extendedprice, quantity) AS intercept,
      {_sql_pearson('quantity', 'extendedprice')} AS r, regr_count(extendedprice, quantity) AS n,
      min(quantity) FILTER (WHERE extendedprice IS NOT NULL) AS lo, max(quantity) FILTER (WHERE extendedprice IS NOT NULL) AS hi
      FROM p3 GROUP BY 1),
p AS (SELECT g.*, t.i AS grid_index, CASE WHEN t.i = 99 THEN hi ELSE lo + t.i * ((hi - lo) / 99.0) END AS x
      FROM g, range(0, 100) t(i))
SELECT series_id, slope, intercept, r, n, grid_index, x, intercept + slope * x AS y_fit FROM p""",
          doubles="slope intercept r x y_fit", ints="n grid_index")
def q_linear_trend(spark, sf_dir):
    return linear_trend(p3_measure_panel(spark, sf_dir), K, "quantity", "extendedprice", 100)


@register("skew_std", f"""
WITH {P3_LONG} SELECT series_id, "column", count(value) AS n, stddev_samp(value) AS std, skewness(value) AS skew
FROM p3l GROUP BY 1, 2""", doubles="std skew")
def q_skew_std(spark, sf_dir):
    return skew_std(p3_measure_panel(spark, sf_dir), K, P3_MEASURES)


@register("outlier_summary", f"""
WITH {P3_LONG},
q AS (SELECT series_id, "column", quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM p3l GROUP BY 1, 2),
j AS (SELECT l.value, q.*, q.q3 - q.q1 AS iqr FROM p3l l JOIN q USING (series_id, "column") WHERE l.value IS NOT NULL),
f AS (SELECT *, value < q1 - 1.5 * iqr OR value > q3 + 1.5 * iqr AS o15, value < q1 - 3 * iqr OR value > q3 + 3 * iqr AS o3 FROM j)
SELECT series_id, "column", q1, q3, iqr, count(value) AS n, count_if(o15) AS n_out_1_5,
avg(CAST(o15 AS DOUBLE)) * 100 AS pct_out_1_5, count_if(o3) AS n_out_3, avg(CAST(o3 AS DOUBLE)) * 100 AS pct_out_3
FROM f GROUP BY series_id, "column", q1, q3, iqr""",
          doubles="q1 q3 iqr pct_out_1_5 pct_out_3", ints="n_out_1_5 n_out_3")
def q_outlier_summary(spark, sf_dir):
    return outlier_summary(p3_measure_panel(spark, sf_dir), K, P3_MEASURES)


P3_SPLIT = f"""{P3},
s AS (SELECT *, CASE WHEN row_number() OVER ({W}) > count(*) OVER (PARTITION BY series_id)
      - ceil(count(*) OVER (PARTITION BY series_id) * 0.2) THEN 'test' ELSE 'train' END AS split FROM p3)"""


def _p3_split(spark, sf_dir):
    return time_split(p3_measure_panel(spark, sf_dir), K, T)


def _fence_sql() -> str:
    fits = ", ".join(f"quantile_cont({c}, 0.25) AS {c}_q1, quantile_cont({c}, 0.75) AS {c}_q3" for c in P3_MEASURES)
    outs = ", ".join(
        f"CASE WHEN {c} IS NOT NULL THEN least(greatest({c}, greatest({c}_q1 - 3.0 * ({c}_q3 - {c}_q1), 0.0)), "
        f"{c}_q3 + 3.0 * ({c}_q3 - {c}_q1)) END AS {c}" for c in P3_MEASURES)
    return f"""WITH {P3_SPLIT}, f AS (SELECT {fits} FROM s WHERE split = 'train')
SELECT series_id, date, split, {outs} FROM s, f"""


@register("winsorize", _fence_sql(), doubles=P3_MEASURES)
def q_winsorize(spark, sf_dir):
    s = _p3_split(spark, sf_dir)
    fences = fit_fences(s.where(F.col("split") == "train"), P3_MEASURES, k=3.0, floor=0.0)
    return fences.transform(s).select("series_id", "date", "split", *P3_MEASURES)


def _scale_sql(final: str) -> str:
    fits = ", ".join(f"quantile_cont({c}, 0.5) AS {c}_m, quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) AS {c}_r"
                     for c in P3_MEASURES)
    outs = ", ".join(f"({c} - {c}_m) / CASE WHEN {c}_r = 0 THEN 1.0 ELSE {c}_r END AS {c}" for c in P3_MEASURES)
    return f"""WITH {P3_SPLIT}, f AS (SELECT {fits} FROM s WHERE split = 'train'),
sc AS (SELECT series_id, date, split, {outs} FROM s, f) {final}"""


@register("robust_scale", _scale_sql("SELECT * FROM sc"), doubles=P3_MEASURES)
def q_robust_scale(spark, sf_dir):
    s = _p3_split(spark, sf_dir)
    scaler = fit_robust_scaler(s.where(F.col("split") == "train"), P3_MEASURES)
    return scaler.transform(s).select("series_id", "date", "split", *P3_MEASURES)


@register("scale_check", _scale_sql(
    ", l AS (SELECT \"column\", value FROM (UNPIVOT sc ON quantity, extendedprice, discount, tax INTO NAME \"column\" VALUE value)) "
    "SELECT \"column\", round(avg(value), 3) AS mean, round(quantile_cont(value, 0.5), 3) AS median FROM l GROUP BY 1"),
    doubles="mean median")
def q_scale_check(spark, sf_dir):
    s = _p3_split(spark, sf_dir)
    scaler = fit_robust_scaler(s.where(F.col("split") == "train"), P3_MEASURES)
    return scale_check(scaler.transform(s), P3_MEASURES)


# --- metrics over deterministic baselines: naive (today), 7- and 30-day trailing means ----------------

BASE_SQL = f"""{P2I},
base AS (SELECT series_id, date, value, avg(value) OVER ({W} ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS ma7,
         avg(value) OVER ({W} ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS ma30, lead(value, 1) OVER ({W}) AS y FROM p2i),
pred AS (SELECT series_id, date, y, m.model, CASE m.model WHEN 'naive' THEN value WHEN 'ma7' THEN ma7 ELSE ma30 END AS yhat
         FROM base, (VALUES ('naive'), ('ma7'), ('ma30')) m(model) WHERE y IS NOT NULL)"""

MODELS = ["naive", "ma7", "ma30"]


def baseline_predictions(spark, sf_dir):
    """Long (series_id, date, y, model, yhat) table for three deterministic forecasters of the next day."""
    p = trailing_mean(p2_filled(spark, sf_dir), K, T, "value", windows=(7, 30))
    p = lead_target(p, K, T, "value", name="y").where(F.col("y").isNotNull())
    models = F.inline(F.array(
        F.struct(F.lit("naive").alias("model"), F.col("value").alias("yhat")),
        F.struct(F.lit("ma7").alias("model"), F.col("trailing_mean_7").alias("yhat")),
        F.struct(F.lit("ma30").alias("model"), F.col("trailing_mean_30").alias("yhat"))))
    return p.select("series_id", "date", "y", models)


def _metrics_sql(group: str, src: str = "pred") -> str:
    e = f"(y - {clip('yhat', 0.0, 500.0)})"
    return (f"SELECT {group}, count(*) AS n, avg(abs({e})) AS mae, avg({e} * {e}) AS mse, sqrt(avg({e} * {e})) AS rmse, "
            f"1 - sum({e} * {e}) / (var_pop(y) * count(*)) AS r2, avg(abs({e} / (y + 1e-9))) * 100 AS mape "
            f"FROM {src} WHERE {clip('yhat', 0.0, 500.0)} IS NOT NULL AND y IS NOT NULL GROUP BY {group}")


METRIC_DOUBLES = "mae mse rmse r2 mape"


@register("regression_metrics", f"WITH {BASE_SQL} {_metrics_sql('model')}", doubles=METRIC_DOUBLES)
def q_regression_metrics(spark, sf_dir):
    return regression_metrics(baseline_predictions(spark, sf_dir), ["model"])


@register("leaderboard", f"""
WITH {BASE_SQL}, m AS ({_metrics_sql('model')})
SELECT *, row_number() OVER (ORDER BY r2 DESC, model) = 1 AS best_r2, row_number() OVER (ORDER BY mae, model) = 1 AS best_mae,
row_number() OVER (ORDER BY rmse, model) = 1 AS best_rmse, row_number() OVER (ORDER BY mse, model) = 1 AS best_mse,
row_number() OVER (ORDER BY mape, model) = 1 AS best_mape, row_number() OVER (ORDER BY rmse, model) AS position FROM m""",
          doubles=METRIC_DOUBLES, ints="position")
def q_leaderboard(spark, sf_dir):
    return leaderboard(regression_metrics(baseline_predictions(spark, sf_dir), ["model"]))


@register("error_by_month", f"""
WITH {BASE_SQL}, g AS (SELECT model, month(date) AS month, avg(abs(y - yhat)) AS mae, count(*) AS n FROM pred
WHERE yhat IS NOT NULL GROUP BY 1, 2)
SELECT *, first(month ORDER BY mae DESC, month) OVER (PARTITION BY model) AS worst_month FROM g""",
          doubles="mae", ints="month worst_month")
def q_error_by_month(spark, sf_dir):
    return error_by_month(baseline_predictions(spark, sf_dir).where(F.col("yhat").isNotNull()), ["model"], T)


@register("residual_hist", _hist_sql(BASE_SQL + ", r AS (SELECT model, y - yhat AS residual FROM pred)", "r",
                                     "residual", 40, keys="model"), doubles="bin_lo bin_hi", ints="bin count")
def q_residual_hist(spark, sf_dir):
    return residual_histogram(baseline_predictions(spark, sf_dir), ["model"], bins=40)


@register("residual_summary", f"""
WITH {BASE_SQL} SELECT model, avg(y - yhat) AS mean_residual, stddev_samp(y - yhat) AS std_residual,
min(y - yhat) AS min_residual, max(y - yhat) AS max_residual FROM pred GROUP BY 1""",
          doubles="mean_residual std_residual min_residual max_residual")
def q_residual_summary(spark, sf_dir):
    return residual_summary(baseline_predictions(spark, sf_dir), ["model"])


FOLD_SQL = f"""{BASE_SQL},
b AS (SELECT *, row_number() OVER (PARTITION BY series_id, model ORDER BY date) - 1 AS rn,
      count(*) OVER (PARTITION BY series_id, model) AS n FROM pred),
f AS (SELECT b.*, t.fold, n - 5 * (n // 6) + t.fold * (n // 6) AS start_, n // 6 AS size_ FROM b, range(0, 5) t(fold)),
ft AS (SELECT * FROM f WHERE rn >= start_ AND rn < start_ + size_)"""


def fold_predictions(spark, sf_dir):
    p = baseline_predictions(spark, sf_dir)
    return time_series_folds(p, ["series_id", "model"], T, k=5).where(F.col("role") == "test")


@register("cv_summary", f"""
WITH {FOLD_SQL}, m AS ({_metrics_sql('model, fold', 'ft')})
SELECT model, round(avg(r2), 4) AS r2_mean, round(stddev_samp(r2), 4) AS r2_std, round(avg(mae), 4) AS mae_mean,
round(avg(rmse), 4) AS rmse_mean, count(*) AS folds FROM m GROUP BY 1""", doubles="r2_mean r2_std mae_mean rmse_mean")
def q_cv_summary(spark, sf_dir):
    return cv_summary(regression_metrics(fold_predictions(spark, sf_dir), ["model", "fold"]), ["model"])


@register("fit_gap", f"""
WITH {BASE_SQL},
s AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY series_id, model ORDER BY date) >
      count(*) OVER (PARTITION BY series_id, model) - ceil(count(*) OVER (PARTITION BY series_id, model) * 0.2)
      THEN 'test' ELSE 'train' END AS split FROM pred),
m AS ({_metrics_sql('model, split', 's')})
SELECT model, max(r2) FILTER (WHERE split = 'train') AS r2_train, max(r2) FILTER (WHERE split = 'test') AS r2_test,
max(r2) FILTER (WHERE split = 'train') - max(r2) FILTER (WHERE split = 'test') AS gap FROM m GROUP BY 1""",
          doubles="r2_train r2_test gap")
def q_fit_gap(spark, sf_dir):
    s = time_split(baseline_predictions(spark, sf_dir), ["series_id", "model"], T)
    return fit_gap(regression_metrics(s, ["model", "split"]), ["model"])


CLASS_SQL = f"""{BASE_SQL},
cls AS (SELECT series_id, date, {sql_class('y')} AS truth, {sql_class('yhat')} AS predicted FROM pred WHERE model = 'naive')"""


def naive_classes(spark, sf_dir):
    p = baseline_predictions(spark, sf_dir).where(F.col("model") == "naive")
    return p.select("series_id", "date", aqi_class("y").alias("truth"), aqi_class("yhat").alias("predicted"))


@register("confusion_matrix", f"""
WITH {CLASS_SQL}, labels AS (SELECT * FROM range(0, 6) t(l)),
c AS (SELECT truth, predicted, count(*) AS n FROM cls WHERE truth IN (0, 1, 2, 3, 4, 5) GROUP BY 1, 2)
SELECT a.l AS truth, b.l AS predicted, coalesce(c.n, 0) AS n FROM labels a CROSS JOIN labels b
LEFT JOIN c ON c.truth = a.l AND c.predicted = b.l""", ints="truth predicted n")
def q_confusion_matrix(spark, sf_dir):
    return confusion_matrix(naive_classes(spark, sf_dir), "truth", "predicted", list(range(6)))


def _cls_metric_sql() -> str:
    per = " UNION ALL ".join(
        f"SELECT '{j}' AS label, count_if(truth = {j} AND predicted = {j}) AS tp, count_if(predicted = {j}) AS pp, "
        f"count_if(truth = {j}) AS support FROM x" for j in range(4))
    return f"""
WITH {CLASS_SQL}, x AS (SELECT * FROM cls WHERE truth IS NOT NULL AND predicted IS NOT NULL),
tot AS (SELECT count(*) AS n, count_if(truth = predicted) AS hit FROM x),
per AS ({per}),
pr AS (SELECT label, support, CASE WHEN pp = 0 THEN 0.0 ELSE tp / pp END AS precision,
       CASE WHEN support = 0 THEN 0.0 ELSE tp / support END AS recall FROM per),
f1 AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0.0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM pr)
SELECT label, precision, recall, f1, support, hit / n AS accuracy, avg(precision) OVER () AS macro_precision,
avg(recall) OVER () AS macro_recall, avg(f1) OVER () AS macro_f1, sum(f1 * support) OVER () / n AS weighted_f1
FROM f1, tot"""


@register("classification_metrics", _cls_metric_sql(),
          doubles="precision recall f1 accuracy macro_precision macro_recall macro_f1 weighted_f1", ints="support")
def q_classification_metrics(spark, sf_dir):
    return classification_metrics(naive_classes(spark, sf_dir), "truth", "predicted", [0, 1, 2, 3])


@register("balanced_weights", f"""
WITH {CLASS_SQL}, c AS (SELECT truth, count(*) AS nc FROM cls WHERE truth IS NOT NULL GROUP BY 1),
w AS (SELECT truth, sum(nc) OVER () / (count(*) OVER () * nc) AS weight FROM c)
SELECT cls.series_id, cls.date, cls.truth, w.weight FROM cls LEFT JOIN w USING (truth)""", doubles="weight", ints="truth")
def q_balanced_weights(spark, sf_dir):
    return balanced_weights(naive_classes(spark, sf_dir).select("series_id", "date", "truth"), "truth")


@register("coverage", SPLIT_SQL + """ SELECT series_id, min(date) AS first_date, max(date) AS last_date, count(*) AS rows,
count_if(split = 'train') AS train_rows, count_if(split = 'test') AS test_rows, 1 AS n_features FROM s GROUP BY 1""",
          ints="train_rows test_rows n_features")
def q_coverage(spark, sf_dir):
    return coverage(time_split(p2_filled(spark, sf_dir), K, T), K, T, features=["value", "missing"])
