"""Sources and sinks (A), projections/filters (B) and scalar functions (G)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelstack.functions.bands import BAND_EDGES, BAND_LABELS, aqi_band, aqi_band_code, aqi_class, clip
from panelstack.functions.calendar import calendar_parts, cyclic_features, flag_features, local_stamp, minmax_normalise
from panelstack.operators.clean import (
    between_dates, drop_incomplete, fallback_row, fill_median, fit_medians, null_audit, threshold_counts,
)
from panelstack.operators.grid import to_daily_grid
from panelstack.operators.stats import band_distribution
from panelstack.operators.windows import lag_features, time_split, trailing_mean
from panelstack.plans.panels import K, daily_events, p2_filled
from panelstack.plans.registry import register
from panelstack.plans.sqlparts import BANDS, DAILY, P1, P2, P2I, aqi_class as sql_class, band_code, band_label, clip as sql_clip, grid
from panelstack.sources.fixtures import p1_hourly_panel, p2_daily_panel, region_daily_panel, table
from panelstack.sources.readers import build_hourly_payload, explode_hourly, lenient_dates, read_checked, read_observations
from panelstack.session import scratch_path
from panelstack.sources.writers import ADVICE_SCHEMA, latest_json, read_advice, upsert_predictions, upsert_rows, write_panel

# --- flagship: raw readings -> daily mean -> band -> share of series-days per band --------------

BAND_SHARE_SQL = f"""
WITH {DAILY}, {BANDS},
counts AS (SELECT series_id, {band_code('value')} AS band_code, count(*) AS n FROM daily
           WHERE value IS NOT NULL GROUP BY 1, 2),
totals AS (SELECT series_id, count(value) AS total FROM daily GROUP BY 1)
SELECT t.series_id, b.band_code, b.band, coalesce(c.n, 0) AS n_days, coalesce(c.n, 0) * 100.0 / t.total AS pct
FROM totals t CROSS JOIN bands b LEFT JOIN counts c ON c.series_id = t.series_id AND c.band_code = b.band_code
"""


def band_share(spark, sf_dir):
    return band_distribution(daily_events(spark, sf_dir), K, "value")


register("band_share", BAND_SHARE_SQL, doubles="pct", ints="band_code n_days")(band_share)


@register("daily_mean", f"WITH {DAILY} SELECT series_id, day, value FROM daily", doubles="value")
def q_daily_mean(spark, sf_dir):
    return daily_events(spark, sf_dir)


@register("scan_panel", f"WITH {P2} SELECT * FROM p2", doubles="value")
def q_scan_panel(spark, sf_dir):
    """The daily panel written as a table and read by the observation reader."""
    path = scratch_path(spark, "observations")
    write_panel(p2_daily_panel(spark, sf_dir), path)
    return read_observations(spark, path, "series_id string, date date, value double")


# Lines of a written CSV by the last digits of the order number: no number, no date, a field too few, one too many, an empty price.
BAD_PRICE, BAD_DATE, TOO_FEW, TOO_MANY, NO_PRICE = 1, 2, 3, 4, 5


@register("checked_lines", f"""
WITH o AS (SELECT o_orderkey, o_orderkey % 50 AS kind FROM orders),
c AS (SELECT o_orderkey, kind, CASE kind WHEN {BAD_PRICE} THEN 'value' WHEN {BAD_DATE} THEN 'value' WHEN {TOO_FEW} THEN 'fields' WHEN {TOO_MANY} THEN 'fields' ELSE 'accepted' END AS outcome,
      CASE kind WHEN {BAD_PRICE} THEN 'price' WHEN {BAD_DATE} THEN 'date' ELSE '' END AS columns FROM o)
SELECT outcome, columns, count(*) AS lines, count(CASE WHEN outcome = 'accepted' AND kind <> {NO_PRICE} THEN 1 END) AS prices,
CAST(sum(o_orderkey) AS BIGINT) AS order_sum FROM c GROUP BY 1, 2""", ints="lines prices order_sum")
def q_checked_lines(spark, sf_dir):
    """A CSV with planted bad lines: what is accepted, and what is rejected for which reason."""
    kind, price = F.col("o_orderkey") % 50, F.col("o_totalprice").cast("string")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    price = F.when(kind == BAD_PRICE, "n/a").when(kind == NO_PRICE, "").otherwise(price)
    fields = F.array(F.col("o_orderkey").cast("string"), F.when(kind == BAD_DATE, "1999-13-45").otherwise(day), price)
    fields = F.when(kind == TOO_FEW, F.slice(fields, 1, 2)).when(kind == TOO_MANY, F.concat(fields, F.array(F.lit("more")))).otherwise(fields)
    path = scratch_path(spark, "lines")
    table(spark, sf_dir, "orders").select(F.array_join(fields, ",").alias("value")).write.text(path)
    rows, rejects = read_checked(spark, path, "order_id BIGINT, date DATE, price DOUBLE", header=False)
    accepted = rows.agg(F.lit("accepted").alias("outcome"), F.lit("").alias("columns"), F.count(F.lit(1)).alias("lines"), F.count("price").alias("prices"), F.sum("order_id").alias("order_sum"))
    number = F.split("line", ",")[0].try_cast("long")
    lost = rejects.groupBy(F.col("reason").alias("outcome"), "columns").agg(F.count(F.lit(1)).alias("lines"), F.lit(0).cast("long").alias("prices"), F.sum(number).alias("order_sum"))
    return accepted.unionByName(lost)


@register("dim_join", """
SELECT r.r_name AS series_id, CAST(o.o_orderdate AS DATE) AS date, avg(o.o_totalprice) / 1000.0 AS value,
       count(*) AS n_orders
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY 1, 2""", doubles="value")
def q_dim_join(spark, sf_dir):
    return region_daily_panel(spark, sf_dir)


@register("explode_hourly", f"WITH {P1} SELECT series_id, hour AS ts, value FROM p1", doubles="value")
def q_explode_hourly(spark, sf_dir):
    payload = build_hourly_payload(p1_hourly_panel(spark, sf_dir), K, "hour", ["value"])
    return explode_hourly(payload, K, ["value"])


# --- prediction log: naive forecasts for every day, replaced by MA-7 forecasts for the last 60 days ---

LOG_CTES = f"""{P2I},
ma AS (SELECT series_id, date, value, avg(value) OVER (PARTITION BY series_id ORDER BY date
       ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS ma7, max(date) OVER (PARTITION BY series_id) AS last_day FROM p2i),
log AS (SELECT series_id, date AS prediction_date, CAST(date + 1 AS DATE) AS predicted_for_date, value AS actual_today,
        value AS predicted, 'naive' AS model FROM ma),
new AS (SELECT series_id, date AS prediction_date, CAST(date + 1 AS DATE) AS predicted_for_date, value AS actual_today,
        ma7 AS predicted, 'ma7' AS model FROM ma WHERE date > last_day - 60),
u AS (SELECT * FROM log WHERE NOT EXISTS (SELECT 1 FROM new WHERE new.series_id = log.series_id
      AND new.prediction_date = log.prediction_date) UNION ALL SELECT * FROM new)"""
UPSERT_SQL = f"""WITH {LOG_CTES} SELECT *, CAST(date_trunc('month', prediction_date) AS DATE) AS month,
CASE WHEN model = 'ma7' THEN 7.0::DOUBLE END AS window_days FROM u"""
LOG_KEYS = ["series_id", "prediction_date"]


def _log_parts(spark, sf_dir):
    """The naive forecasts of every day, and the 7-day means of the last 60."""
    p = trailing_mean(p2_filled(spark, sf_dir), K, "date", "value", windows=(7,))
    p = p.withColumn("_last", F.max("date").over(Window.partitionBy(*K)))
    cols = [F.col("series_id"), F.col("date").alias("prediction_date"),
            F.date_add("date", 1).alias("predicted_for_date"), F.col("value").alias("actual_today")]
    log = p.select(*cols, F.col("value").alias("predicted"), F.lit("naive").alias("model"))
    new = p.where(F.col("date") > F.date_sub("_last", 60)).select(
        *cols, F.col("trailing_mean_7").alias("predicted"), F.lit("ma7").alias("model"))
    return log, new


def prediction_log(spark, sf_dir):
    log, new = _log_parts(spark, sf_dir)
    return upsert_rows(log, new, LOG_KEYS)


@register("upsert_log", UPSERT_SQL, doubles="actual_today predicted window_days")
def q_upsert_log(spark, sf_dir):
    """Two batches through the sink at a path; the second brings a new column and repeats each of its rows."""
    path = scratch_path(spark, "prediction_log")
    log, new = (x.withColumn("month", F.trunc("prediction_date", "month")) for x in _log_parts(spark, sf_dir))
    upsert_predictions(spark, log, path, LOG_KEYS, partition_col="month")
    new = new.withColumn("window_days", F.lit(7.0))
    out = upsert_predictions(spark, new.unionByName(new), path, LOG_KEYS, partition_col="month")
    return out.select("series_id", "prediction_date", "predicted_for_date", "actual_today", "predicted", "model", "month", "window_days")


def band_advice(spark):
    """An advice dimension from the band edges, written as JSON lines and read back as a user's table would be."""
    path = scratch_path(spark, "advice")
    rows = [(label, "*" * (i + 1), f"{label}: index from {BAND_EDGES[i]} to {BAND_EDGES[i + 1]}", [f"level {j}" for j in range(i + 1)]) for i, label in enumerate(BAND_LABELS)]
    spark.createDataFrame(rows, ADVICE_SCHEMA).coalesce(1).write.json(path)
    return read_advice(spark, path)


_ADVICE_SQL = " UNION ALL ".join(
    f"SELECT '{label}' AS label, '{'*' * (i + 1)}' AS emoji, '{label}: index from {BAND_EDGES[i]} to {BAND_EDGES[i + 1]}' AS summary, {i + 1} AS n_actions"
    for i, label in enumerate(BAND_LABELS))


@register("latest_json", f"""
WITH {LOG_CTES}, {BANDS}, a AS ({_ADVICE_SQL}),
r AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY prediction_date DESC) AS n FROM u)
SELECT r.series_id, r.prediction_date, r.predicted_for_date, r.actual_today, r.predicted, r.model, b.band AS aqi_category,
a.emoji, a.summary, a.n_actions FROM r JOIN bands b ON b.band_code = {band_code('r.predicted')} JOIN a ON a.label = b.band WHERE r.n = 1""",
          doubles="actual_today predicted", ints="n_actions")
def q_latest_json(spark, sf_dir):
    """The newest row of every series as JSON with its advice, parsed again."""
    log = prediction_log(spark, sf_dir).withColumn("aqi_category", aqi_band("predicted"))
    made = latest_json(log, band_advice(spark), K)
    schema = ("prediction_date date, predicted_for_date date, actual_today double, predicted double, model string, aqi_category string, "
              "advice struct<emoji: string, summary: string, actions: array<string>>")
    r = made.select("series_id", F.from_json("json", schema).alias("r"))
    return r.select("series_id", "r.prediction_date", "r.predicted_for_date", "r.actual_today", "r.predicted", "r.model", "r.aqi_category",
                    "r.advice.emoji", "r.advice.summary", F.size("r.advice.actions").alias("n_actions"))


@register("lenient_dates", """
SELECT o_orderkey, CAST(coalesce(try_strptime(s, '%Y-%m-%d'), try_strptime(s, '%Y-%m-%d %H:%M:%S'),
       try_strptime(s, '%d/%m/%Y')) AS DATE) AS order_date
FROM (SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN strftime(o_orderdate, '%Y-%m-%d')
      WHEN 'F' THEN strftime(o_orderdate, '%d/%m/%Y') ELSE 'n/a' END AS s FROM orders)""")
def q_lenient_dates(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    s = (F.when(F.col("o_orderstatus") == "O", F.date_format("o_orderdate", "yyyy-MM-dd"))
         .when(F.col("o_orderstatus") == "F", F.date_format("o_orderdate", "dd/MM/yyyy")).otherwise(F.lit("n/a")))
    return lenient_dates(o.select("o_orderkey", s.alias("order_date")), ["order_date"])


# --- B: filters and conditionals ---------------------------------------------------------------

@register("date_range", """
SELECT o_orderpriority AS series_id, CAST(o_orderdate AS DATE) AS date, avg(o_totalprice) / 1000.0 AS value
FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1996-01-01' AND DATE '1997-12-31' GROUP BY 1, 2""",
          doubles="value")
def q_date_range(spark, sf_dir):
    o = between_dates(table(spark, sf_dir, "orders"), "o_orderdate", "1996-01-01", "1997-12-31")
    return (o.groupBy(F.col("o_orderpriority").alias("series_id"), F.to_date("o_orderdate").alias("date"))
            .agg((F.avg("o_totalprice") / 1000.0).alias("value")))


@register("exceedance", f"""
WITH {P2I}
SELECT series_id, count(value) AS n,
  count_if(value > 100) AS n_above_100, avg(CASE WHEN value > 100 THEN 1.0 ELSE 0.0 END) * 100 AS pct_above_100,
  count_if(value <= 50) AS n_at_most_50, avg(CASE WHEN value <= 50 THEN 1.0 ELSE 0.0 END) * 100 AS pct_at_most_50,
  count_if(value > 12) AS n_above_12, avg(CASE WHEN value > 12 THEN 1.0 ELSE 0.0 END) * 100 AS pct_above_12,
  count_if(value > 35.4) AS n_above_35_4, avg(CASE WHEN value > 35.4 THEN 1.0 ELSE 0.0 END) * 100 AS pct_above_35_4
FROM p2i GROUP BY 1""", doubles="pct_above_100 pct_at_most_50 pct_above_12 pct_above_35_4",
          ints="n_above_100 n_at_most_50 n_above_12 n_above_35_4")
def q_exceedance(spark, sf_dir):
    return threshold_counts(p2_filled(spark, sf_dir), K, "value")


@register("aqi_band", f"WITH {P2I} SELECT series_id, date, value, {band_label('value')} AS band, "
          f"{band_code('value')} AS band_code FROM p2i", doubles="value", ints="band_code")
def q_aqi_band(spark, sf_dir):
    p = p2_filled(spark, sf_dir)
    return p.select("series_id", "date", "value", aqi_band("value").alias("band"), aqi_band_code("value").alias("band_code"))


@register("aqi_class", f"WITH {P2I} SELECT series_id, date, value, {sql_class('value')} AS aqi_class FROM p2i",
          doubles="value", ints="aqi_class")
def q_aqi_class(spark, sf_dir):
    p = p2_filled(spark, sf_dir)
    return p.select("series_id", "date", "value", aqi_class("value").alias("aqi_class"))


@register("clip", f"WITH {P2I} SELECT series_id, date, {sql_clip('(value - 50.0) * 2.0', 0.0, 500.0)} AS clipped FROM p2i",
          doubles="clipped")
def q_clip(spark, sf_dir):
    p = p2_filled(spark, sf_dir)
    return p.select("series_id", "date", clip((F.col("value") - 50.0) * 2.0, 0.0, 500.0).alias("clipped"))


@register("null_audit", f"""
WITH {P2}, {grid('p2')},
g AS (SELECT series_id, date, value, lag(value, 7) OVER (PARTITION BY series_id ORDER BY date) AS lag_7 FROM grid),
a AS (SELECT series_id, count(*) AS rows_, count_if(value IS NULL OR lag_7 IS NULL) AS rows_with_null,
      count_if(value IS NULL) AS n_value, count_if(lag_7 IS NULL) AS n_lag_7 FROM g GROUP BY 1)
SELECT series_id, rows_with_null, 'value' AS "column", 'double' AS dtype, n_value AS null_count,
       round(n_value * 100.0 / rows_, 3) AS null_pct FROM a
UNION ALL SELECT series_id, rows_with_null, 'lag_7', 'double', n_lag_7, round(n_lag_7 * 100.0 / rows_, 3) FROM a""",
          doubles="null_pct", ints="rows_with_null null_count")
def q_null_audit(spark, sf_dir):
    g = lag_features(to_daily_grid(p2_daily_panel(spark, sf_dir), K, "date"), K, "date", "value", lags=(7,))
    return null_audit(g.drop("date"), K)


@register("drop_incomplete", f"""
WITH {P2}, {grid('p2')}
SELECT * FROM (SELECT series_id, date, value, lag(value, 1) OVER (PARTITION BY series_id ORDER BY date) AS lag_1
FROM grid) WHERE value IS NOT NULL AND lag_1 IS NOT NULL""", doubles="value lag_1")
def q_drop_incomplete(spark, sf_dir):
    g = lag_features(to_daily_grid(p2_daily_panel(spark, sf_dir), K, "date"), K, "date", "value", lags=(1,))
    return drop_incomplete(g)


@register("fill_median", f"""
WITH {P2}, {grid('p2')},
s AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY series_id ORDER BY date) >
      count(*) OVER (PARTITION BY series_id) - ceil(count(*) OVER (PARTITION BY series_id) * 0.2) THEN 'test' ELSE 'train' END AS split
      FROM grid),
m AS (SELECT series_id, quantile_cont(value, 0.5) AS med FROM s WHERE split = 'train' GROUP BY 1)
SELECT s.series_id, s.date, s.split, coalesce(s.value, m.med) AS value FROM s LEFT JOIN m USING (series_id)""",
          doubles="value")
def q_fill_median(spark, sf_dir):
    s = time_split(to_daily_grid(p2_daily_panel(spark, sf_dir), K, "date"), K, "date")
    med = fit_medians(s.where(F.col("split") == "train"), ["value"], K)
    return fill_median(s, med, ["value"], K).select("series_id", "date", "split", "value")


@register("fallback_row", f"""
WITH {DAILY},
last AS (SELECT series_id, max(day) AS last_day, arg_max(value, day) FILTER (WHERE value IS NOT NULL) AS last_value
         FROM daily GROUP BY 1)
SELECT series_id, CAST(last_day + 1 AS DATE) AS day, coalesce(last_value, 0.0) AS value FROM last""", doubles="value")
def q_fallback_row(spark, sf_dir):
    hist = daily_events(spark, sf_dir)
    today = hist.groupBy(*K).agg(F.date_add(F.max("day"), 1).alias("day")).withColumn("value", F.lit(None).cast("double"))
    return fallback_row(today, hist, K, "day", ["value"], {"value": 0.0})


# --- G: scalar functions -----------------------------------------------------------------------

@register("calendar_parts", f"""
WITH {P2I} SELECT series_id, date, year(date) AS year, month(date) AS month, day(date) AS day,
isodow(date) - 1 AS weekday, dayofyear(date) AS day_of_year FROM p2i""", ints="year month day weekday day_of_year")
def q_calendar_parts(spark, sf_dir):
    return calendar_parts(p2_filled(spark, sf_dir).select("series_id", "date"), "date")


@register("cyclic", f"""
WITH {P2I} SELECT series_id, date,
sin(2 * pi() * month(date) / 12) AS month_sin, cos(2 * pi() * month(date) / 12) AS month_cos,
sin(2 * pi() * (isodow(date) - 1) / 7) AS weekday_sin, cos(2 * pi() * (isodow(date) - 1) / 7) AS weekday_cos,
sin(2 * pi() * dayofyear(date) / 365) AS day_of_year_sin, cos(2 * pi() * dayofyear(date) / 365) AS day_of_year_cos
FROM p2i""", doubles="month_sin month_cos weekday_sin weekday_cos day_of_year_sin day_of_year_cos")
def q_cyclic(spark, sf_dir):
    return p2_filled(spark, sf_dir).select("series_id", "date").withColumns(cyclic_features("date"))


@register("flags", f"""
WITH {P2I} SELECT series_id, date, CAST(isodow(date) - 1 >= 5 AS INTEGER) AS is_weekend,
CAST(month(date) IN (12, 1, 2, 3, 4) AS INTEGER) AS is_dry_season FROM p2i""", ints="is_weekend is_dry_season")
def q_flags(spark, sf_dir):
    return p2_filled(spark, sf_dir).select("series_id", "date").withColumns(flag_features("date"))


@register("next_day", f"""
WITH {P1} SELECT series_id, hour, CAST(CAST(hour AS DATE) + 1 AS DATE) AS next_date,
strftime(hour + INTERVAL 7 HOUR, '%Y-%m-%d %H:%M:%S') AS local_stamp FROM p1""")
def q_next_day(spark, sf_dir):
    p = p1_hourly_panel(spark, sf_dir)
    return p.select("series_id", "hour", F.date_add(F.to_date("hour"), 1).alias("next_date"),
                    local_stamp(F.col("hour").cast("timestamp"), "Asia/Ho_Chi_Minh").alias("local_stamp"))


@register("minmax", f"""
WITH {P2I} SELECT series_id, date, (value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w + 1e-9) AS scaled
FROM p2i WINDOW w AS (PARTITION BY series_id)""", doubles="scaled")
def q_minmax(spark, sf_dir):
    p = p2_filled(spark, sf_dir)
    w = Window.partitionBy(*K)
    return p.select("series_id", "date",
                    minmax_normalise("value", F.min("value").over(w), F.max("value").over(w)).alias("scaled"))
