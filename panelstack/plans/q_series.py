"""Regularising, gap filling and joins (C) and ordered/window operators (D)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelstack.functions.bands import aqi_class
from panelstack.operators.combine import (
    append_and_tail, forecast_vs_actual, join_on_time, lookup_band, rank_compare, union_rows,
)
from panelstack.operators.decompose import seasonal_decompose
from panelstack.operators.grid import interpolate, to_daily_grid
from panelstack.operators.stats import pearson
from panelstack.operators.windows import (
    centered_mean, diff_features, extremes, lag_features, last_n, latest_row, lead_target, ordered_sample,
    rolling_features, time_series_folds, time_split, trailing_mean,
)
from panelstack.plans.panels import K, p2_filled
from panelstack.plans.q_basic import LOG_CTES, prediction_log
from panelstack.plans.registry import register
from panelstack.plans.sqlparts import P2, P2I, P3, W, aqi_class as sql_class, grid, interp
from panelstack.sources.fixtures import p2_daily_panel, p3_measure_panel

T = "date"

# --- C: grid, interpolation, unions and joins -------------------------------------------------------


@register("daily_grid", f"WITH {P2}, {grid('p2')} SELECT * FROM grid", doubles="value")
def q_daily_grid(spark, sf_dir):
    return to_daily_grid(p2_daily_panel(spark, sf_dir), K, T)


@register("interp_time", f"WITH {P2I} SELECT * FROM p2i", doubles="value")
def q_interp_time(spark, sf_dir):
    return p2_filled(spark, sf_dir)


@register("interp_linear_bfill",
          f"WITH {P2}, {grid('p2')}, {interp('grid', 'g2', ['value'], 'linear', 'both')} SELECT * FROM g2",
          doubles="value")
def q_interp_linear_bfill(spark, sf_dir):
    g = to_daily_grid(p2_daily_panel(spark, sf_dir), K, T)
    return interpolate(g, K, T, ["value"], method="linear", edges="both")


@register("interp_forward",
          f"WITH {P2}, {grid('p2')}, {interp('grid', 'g2', ['value'], 'linear', 'forward')} SELECT * FROM g2",
          doubles="value")
def q_interp_forward(spark, sf_dir):
    g = to_daily_grid(p2_daily_panel(spark, sf_dir), K, T)
    return interpolate(g, K, T, ["value"], method="linear", edges="forward")


@register("append_tail", f"""
WITH {P2I},
last AS (SELECT series_id, max(date) AS last_day FROM p2i GROUP BY 1),
today AS (SELECT p.series_id, p.date, p.value * 1.1 AS value FROM p2i p JOIN last l
          ON p.series_id = l.series_id AND p.date = l.last_day),
hist AS (SELECT * FROM p2i h WHERE NOT EXISTS (SELECT 1 FROM today t WHERE t.series_id = h.series_id AND t.date = h.date)),
tail AS (SELECT series_id, date, value FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY date DESC) AS r
         FROM hist) WHERE r <= 60)
SELECT * FROM tail UNION ALL SELECT * FROM today""", doubles="value")
def q_append_tail(spark, sf_dir):
    p = p2_filled(spark, sf_dir)
    last = p.groupBy(*K).agg(F.max(T).alias(T))
    today = p.join(last, on=K + [T], how="left_semi").withColumn("value", F.col("value") * 1.1)
    return append_and_tail(p, today, K, T, n=60)


SPLIT_SQL = f"""
WITH {P2I},
s AS (SELECT series_id, date, value, CASE WHEN row_number() OVER ({W}) >
      count(*) OVER (PARTITION BY series_id) - ceil(count(*) OVER (PARTITION BY series_id) * 0.2) THEN 'test'
      ELSE 'train' END AS split FROM p2i)"""


@register("time_split", SPLIT_SQL + " SELECT * FROM s", doubles="value")
def q_time_split(spark, sf_dir):
    return time_split(p2_filled(spark, sf_dir), K, T)


@register("union_splits", SPLIT_SQL + " SELECT * FROM s WHERE split = 'train' UNION ALL SELECT * FROM s WHERE split = 'test'",
          doubles="value")
def q_union_splits(spark, sf_dir):
    s = time_split(p2_filled(spark, sf_dir), K, T)
    return union_rows(s.where(F.col("split") == "train"), s.where(F.col("split") == "test"))


@register("join_xy", f"""
WITH {P2I},
x AS (SELECT series_id, date, lag(value, 1) OVER ({W}) AS lag_1, lag(value, 7) OVER ({W}) AS lag_7 FROM p2i),
y AS (SELECT series_id, date, lead(value, 1) OVER ({W}) AS target FROM p2i)
SELECT * FROM x JOIN y USING (series_id, date)""", doubles="lag_1 lag_7 target")
def q_join_xy(spark, sf_dir):
    p = p2_filled(spark, sf_dir)
    x = lag_features(p, K, T, "value", lags=(1, 7)).drop("value")
    y = lead_target(p, K, T, "value").drop("value")
    return join_on_time(x, y, K, T)


@register("semi_join", SPLIT_SQL + """,
x AS (SELECT series_id, date, value FROM p2i)
SELECT * FROM x WHERE EXISTS (SELECT 1 FROM s WHERE s.split = 'test' AND s.series_id = x.series_id AND s.date = x.date)""",
          doubles="value")
def q_semi_join(spark, sf_dir):
    p = p2_filled(spark, sf_dir)
    s = time_split(p, K, T).where(F.col("split") == "test")
    return join_on_time(p, s.select(*K, T), K, T, how="left_semi")


@register("lookup_band", f"""
WITH {P2I} SELECT series_id, date, code, coalesce(CASE code WHEN 0 THEN 'Good' WHEN 1 THEN 'Moderate'
WHEN 2 THEN 'Unhealthy for Sensitive Groups' WHEN 3 THEN 'Unhealthy' WHEN 4 THEN 'Very Unhealthy'
WHEN 5 THEN 'Hazardous' END, 'Moderate') AS band_label
FROM (SELECT series_id, date, {sql_class('value')} AS code FROM p2i)""", ints="code")
def q_lookup_band(spark, sf_dir):
    p = p2_filled(spark, sf_dir).select(*K, T, aqi_class("value").alias("code"))
    return lookup_band(p, "code")


RANK_FEATURES = ["quantity", "discount", "tax", "quantity_lag_1", "discount_lag_1", "tax_lag_1"]


def _p3_with_lags(spark, sf_dir):
    p = p3_measure_panel(spark, sf_dir)
    w = Window.partitionBy(*K).orderBy(T)
    return p.withColumns({f"{c}_lag_1": F.lag(c, 1).over(w) for c in ["quantity", "discount", "tax"]}
                         | {"next_price": F.lead("extendedprice", 1).over(w)})


def _sql_pearson(a: str, b: str) -> str:
    aa, bb = f"CASE WHEN {b} IS NOT NULL THEN {a} END", f"CASE WHEN {a} IS NOT NULL THEN {b} END"
    return (f"CASE WHEN stddev_pop({aa}) * stddev_pop({bb}) <> 0 THEN "
            f"covar_pop({aa}, {bb}) / (stddev_pop({aa}) * stddev_pop({bb})) END")


_RANK_SCORES = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, {_sql_pearson(c, 'extendedprice')} AS score_a, {_sql_pearson(c, 'next_price')} AS score_b FROM p3l"
    for c in RANK_FEATURES)


@register("rank_compare", f"""
WITH {P3},
p3l AS (SELECT *, lag(quantity, 1) OVER ({W}) AS quantity_lag_1, lag(discount, 1) OVER ({W}) AS discount_lag_1,
        lag(tax, 1) OVER ({W}) AS tax_lag_1, lead(extendedprice, 1) OVER ({W}) AS next_price FROM p3),
sc AS ({_RANK_SCORES}),
r AS (SELECT feature, score_a, score_b, row_number() OVER (ORDER BY abs(score_a) DESC, feature) AS rank_a,
      row_number() OVER (ORDER BY abs(score_b) DESC, feature) AS rank_b FROM sc)
SELECT feature, score_a, rank_a, score_b, rank_b, abs(rank_a - rank_b) AS rank_diff FROM r WHERE rank_a <= 15""",
          doubles="score_a score_b", ints="rank_a rank_b rank_diff")
def q_rank_compare(spark, sf_dir):
    p = _p3_with_lags(spark, sf_dir)
    rows = []
    for target, name in (("extendedprice", "score_a"), ("next_price", "score_b")):
        g = p.agg(*[pearson(F.col(c), F.col(target)).alias(c) for c in RANK_FEATURES])
        rows.append(g.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias(name))
                                                for c in RANK_FEATURES]))))
    return rank_compare(rows[0], rows[1], "feature", "score_a", "score_b", top=15).select(
        "feature", "score_a", "rank_a", "score_b", "rank_b", "rank_diff")


@register("forecast_vs_actual", f"""
WITH {LOG_CTES} SELECT u.*, a.actual, a.actual - u.predicted AS error FROM u
JOIN (SELECT series_id, date AS predicted_for_date, value AS actual FROM p2i) a USING (series_id, predicted_for_date)""",
          doubles="actual_today predicted actual error")
def q_forecast_vs_actual(spark, sf_dir):
    return forecast_vs_actual(prediction_log(spark, sf_dir), p2_filled(spark, sf_dir), K, T, "value")


# --- D: window operators --------------------------------------------------------------------------

def _lag_sql(ks):
    return ", ".join(f"lag(value, {k}) OVER ({W}) AS lag_{k}" for k in ks)


@register("lag_features", f"WITH {P2I} SELECT series_id, date, value, {_lag_sql([1, 2, 3, 7, 14])} FROM p2i",
          doubles="value lag_1 lag_2 lag_3 lag_7 lag_14")
def q_lag_features(spark, sf_dir):
    return lag_features(p2_filled(spark, sf_dir), K, T, "value")


@register("lag_calendar", f"""
WITH {P2} SELECT a.series_id, a.date, a.value, b.value AS lag_1, c.value AS lag_7 FROM p2 a
LEFT JOIN p2 b ON b.series_id = a.series_id AND b.date = a.date - 1
LEFT JOIN p2 c ON c.series_id = a.series_id AND c.date = a.date - 7""", doubles="value lag_1 lag_7")
def q_lag_calendar(spark, sf_dir):
    return lag_features(p2_daily_panel(spark, sf_dir), K, T, "value", lags=(1, 7), calendar=True)


@register("lead_target", f"WITH {P2I} SELECT series_id, date, value, lead(value, 1) OVER ({W}) AS target FROM p2i",
          doubles="value target")
def q_lead_target(spark, sf_dir):
    return lead_target(p2_filled(spark, sf_dir), K, T, "value")


def _rolling_sql(n: int) -> str:
    frame = f"({W} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
    parts = [f"CASE WHEN count(value) OVER {frame} = {n} THEN {fn}(value) OVER {frame} END AS rolling_{name}_{n}"
             for name, fn in (("mean", "avg"), ("std", "stddev_samp"), ("max", "max"), ("min", "min"))]
    return f"WITH {P2I} SELECT series_id, date, {', '.join(parts)} FROM p2i"


def _rolling_query(n: int):
    def build(spark, sf_dir):
        return rolling_features(p2_filled(spark, sf_dir), K, T, "value", windows=(n,)).drop("value")
    return build


for _n in (3, 7, 14, 30):
    register(f"rolling_{_n}", _rolling_sql(_n),
             doubles=[f"rolling_{f}_{_n}" for f in ("mean", "std", "max", "min")])(_rolling_query(_n))


@register("diff_features", f"WITH {P2I} SELECT series_id, date, value, value - lag(value, 1) OVER ({W}) AS diff_1, "
          f"value - lag(value, 7) OVER ({W}) AS diff_7 FROM p2i", doubles="value diff_1 diff_7")
def q_diff_features(spark, sf_dir):
    return diff_features(p2_filled(spark, sf_dir), K, T, "value")


@register("trailing_mean", f"""
WITH {P2} SELECT series_id, date, value, avg(value) OVER ({W} ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS trailing_mean_7,
avg(value) OVER ({W} ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS trailing_mean_30 FROM p2""",
          doubles="value trailing_mean_7 trailing_mean_30")
def q_trailing_mean(spark, sf_dir):
    return trailing_mean(p2_daily_panel(spark, sf_dir), K, T, "value")


def _centered_sql(n: int) -> str:
    frame = f"({W} ROWS BETWEEN {n // 2} PRECEDING AND {(n - 1) // 2} FOLLOWING)"
    return (f"WITH {P2I} SELECT series_id, date, value, CASE WHEN count(value) OVER {frame} = {n} "
            f"THEN avg(value) OVER {frame} END AS centered_mean_{n} FROM p2i")


def _centered_query(n: int):
    def build(spark, sf_dir):
        return centered_mean(p2_filled(spark, sf_dir), K, T, "value", windows=(n,))
    return build


for _n in (7, 30):
    register(f"centered_mean_{_n}", _centered_sql(_n), doubles=["value", f"centered_mean_{_n}"])(_centered_query(_n))


@register("extremes", f"""
WITH {P2}, m AS (SELECT series_id, max(value) AS max_value, min(value) AS min_value FROM p2 GROUP BY 1)
SELECT m.series_id, m.max_value, (SELECT min(date) FROM p2 WHERE p2.series_id = m.series_id AND p2.value = m.max_value) AS max_date,
m.min_value, (SELECT min(date) FROM p2 WHERE p2.series_id = m.series_id AND p2.value = m.min_value) AS min_date FROM m""",
          doubles="max_value min_value")
def q_extremes(spark, sf_dir):
    return extremes(p2_daily_panel(spark, sf_dir), K, T, "value")


@register("latest_row", f"""
WITH {P2} SELECT series_id, date, value FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY date DESC) AS r
FROM p2) WHERE r = 1""", doubles="value")
def q_latest_row(spark, sf_dir):
    return latest_row(p2_daily_panel(spark, sf_dir), K, T)


@register("last_n", f"""
WITH {P2} SELECT * FROM (SELECT series_id, date, value, row_number() OVER (PARTITION BY series_id ORDER BY date DESC)
AS recency_rank FROM p2) WHERE recency_rank <= 10""", doubles="value", ints="recency_rank")
def q_last_n(spark, sf_dir):
    return last_n(p2_daily_panel(spark, sf_dir), K, T, 10)


def _decompose_sql(period: int) -> str:
    h = period // 2
    frame = f"({W} ROWS BETWEEN {h} PRECEDING AND {h} FOLLOWING)"
    if period % 2:
        trend = f"sum(value) OVER {frame} / {float(period)}"
    else:
        trend = f"(sum(value) OVER {frame} - 0.5 * (lag(value, {h}) OVER ({W}) + lead(value, {h}) OVER ({W}))) / {float(period)}"
    return f"""
WITH {P2I},
t AS (SELECT series_id, date, value, (row_number() OVER ({W}) - 1) % {period} AS phase,
      CASE WHEN count(value) OVER {frame} = {2 * h + 1} THEN {trend} END AS trend FROM p2i),
pm AS (SELECT series_id, phase, avg(value - trend) AS pm FROM t GROUP BY 1, 2),
s AS (SELECT series_id, phase, pm - avg(pm) OVER (PARTITION BY series_id) AS seasonal FROM pm)
SELECT t.series_id, t.date, t.value, t.trend, s.seasonal, t.value - t.trend - s.seasonal AS resid
FROM t LEFT JOIN s USING (series_id, phase)"""


def _decompose_query(period: int):
    def build(spark, sf_dir):
        return seasonal_decompose(p2_filled(spark, sf_dir), K, T, "value", period)
    return build


for _p in (365, 7):
    register(f"decompose_{_p}", _decompose_sql(_p), doubles="value trend seasonal resid")(_decompose_query(_p))


@register("ts_folds", f"""
WITH {P2I},
b AS (SELECT series_id, date, value, row_number() OVER ({W}) - 1 AS rn, count(*) OVER (PARTITION BY series_id) AS n FROM p2i),
f AS (SELECT b.*, t.fold, n - 5 * (n // 6) + t.fold * (n // 6) AS start_, n // 6 AS size_ FROM b, range(0, 5) t(fold))
SELECT series_id, date, value, fold, role FROM (SELECT *, CASE WHEN rn < start_ THEN 'train'
WHEN rn < start_ + size_ THEN 'test' END AS role FROM f) WHERE role IS NOT NULL""", doubles="value", ints="fold")
def q_ts_folds(spark, sf_dir):
    return time_series_folds(p2_filled(spark, sf_dir), K, T, k=5)


@register("ordered_sample", f"""
WITH {P2I},
r AS (SELECT series_id, value, row_number() OVER (PARTITION BY series_id ORDER BY value) - 1 AS position,
      count(*) OVER (PARTITION BY series_id) AS n FROM p2i),
js AS (SELECT s.series_id, s.n, t.j FROM (SELECT DISTINCT series_id, n FROM r) s, range(0, 360) t(j)),
pos AS (SELECT series_id, j, CASE WHEN j = 359 THEN n - 1 ELSE
        CAST(floor(CAST(j AS DOUBLE) * (CAST(n - 1 AS DOUBLE) / 359.0::DOUBLE)) AS BIGINT) END AS position FROM js)
SELECT pos.series_id, pos.j, pos.position, r.value AS sample_value FROM pos JOIN r USING (series_id, position)""",
          doubles="sample_value", ints="j position")
def q_ordered_sample(spark, sf_dir):
    return ordered_sample(p2_filled(spark, sf_dir), K, "value", 360)
