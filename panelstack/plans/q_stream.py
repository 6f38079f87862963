"""Structured Streaming forms (S1-S3): each query runs an ``availableNow`` stream over files
derived from the driver tables, then returns the batch view of the sink."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelstack.operators.forecast import ar_fit
from panelstack.plans.panels import K, p2_filled
from panelstack.plans.registry import register
from panelstack.plans.sqlparts import DAILY, P2I, W, clip
from panelstack.session import materialize, scratch_path
from panelstack.streaming.daily import stream_daily_mean, stream_dedup, stream_score
from panelstack.streaming.state import stream_finished_days, stream_score_state

EVENTS_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


@register("stream_daily_mean", f"WITH {DAILY} SELECT series_id, day, value FROM daily", doubles="value")
def q_stream_daily_mean(spark, sf_dir):
    out = stream_daily_mean(spark, sf_dir, EVENTS_SCHEMA, ["event_type"], "ts", ["value"], watermark="2 days",
                            file_glob="events.parquet")
    return spark.read.parquet(out).select(F.col("event_type").alias("series_id"), F.col("day").cast("date"), "value")


@register("stream_dedup", "SELECT DISTINCT event_type, user_id FROM events")
def q_stream_dedup(spark, sf_dir):
    out = stream_dedup(spark, sf_dir, EVENTS_SCHEMA, ["event_type", "user_id"], "ts", file_glob="events.parquet")
    return spark.read.parquet(out).select("event_type", "user_id")


#: Days of the third and of the sixth part of the readings' span; a reading in so many of one early day comes last.
PARTS, LATE = (10, 20), 7


@register("stream_finished_days", f"""
WITH e AS (SELECT *, CAST(ts AS DATE) - min(CAST(ts AS DATE)) OVER () AS age, max(ts) OVER () AS newest FROM events),
k AS (SELECT * FROM e WHERE NOT (age = 2 AND event_id % {LATE} = 0))
SELECT event_type AS series_id, CAST(ts AS DATE) AS day, avg(value) AS value FROM k
WHERE CAST(ts AS DATE) + INTERVAL 1 DAY <= newest - INTERVAL 2 DAYS GROUP BY 1, 2""", doubles="value")
def q_stream_finished_days(spark, sf_dir):
    """Three deliveries of readings; in the last, readings of a day that has been closed since.  Every closed day comes once."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "event_type", "ts", "value")
    first = events.agg(F.min(F.to_date("ts")).alias("first"))
    e = events.join(F.broadcast(first)).withColumn("age", F.datediff(F.to_date("ts"), "first"))
    late = (F.col("age") == 2) & (F.col("event_id") % LATE == 0)
    arriving, out = scratch_path(spark, "arriving_readings"), scratch_path(spark, "finished_days")
    for part in (~late & (F.col("age") < PARTS[0]), F.col("age").between(PARTS[0], PARTS[1] - 1), late | (F.col("age") >= PARTS[1])):
        e.where(part).select("event_type", "ts", "value").write.mode("append").parquet(arriving)
        stream_finished_days(spark, arriving, "event_type string, ts timestamp_ntz, value double", ["event_type"], "ts", ["value"], out, scale=12)
    return spark.read.parquet(out).select(F.col("event_type").alias("series_id"), "day", "value")


HOLDOUT_DAYS = 30


STREAM_SCORE_SQL = f"""
WITH {P2I},
m AS (SELECT *, max(date) OVER (PARTITION BY series_id) AS last_day, lag(value, 1) OVER ({W}) AS y1 FROM p2i),
c AS (SELECT series_id, regr_intercept(value, y1) AS intercept, regr_slope(value, y1) AS phi,
      sqrt((regr_syy(value, y1) - regr_slope(value, y1) * regr_sxy(value, y1)) / (regr_count(value, y1) - 2)) AS sigma
      FROM m WHERE date <= last_day - {HOLDOUT_DAYS} GROUP BY 1)
SELECT m.series_id, m.date AS prediction_date, CAST(m.date + 1 AS DATE) AS predicted_for_date, m.value AS actual_today,
{clip('(c.intercept + c.phi * m.value)', 0.0, 500.0)} AS predicted, c.intercept + c.phi * m.value - 1.96 * c.sigma AS lower,
c.intercept + c.phi * m.value + 1.96 * c.sigma AS upper FROM m JOIN c USING (series_id) WHERE m.date > m.last_day - {HOLDOUT_DAYS}"""


@register("stream_score", STREAM_SCORE_SQL, doubles="actual_today predicted lower upper")
def q_stream_score(spark, sf_dir):
    """History = all but the last 30 days per series; those days arrive as a file stream and are scored."""
    p = p2_filled(spark, sf_dir).withColumn("_last", F.max("date").over(Window.partitionBy(*K)))
    cutoff = F.date_sub("_last", HOLDOUT_DAYS)
    history = p.where(F.col("date") <= cutoff).drop("_last")
    arriving = scratch_path(spark, "arriving_days")
    p.where(F.col("date") > cutoff).drop("_last").write.parquet(arriving)
    log = stream_score(spark, arriving, "series_id string, date date, value double", history, K, "date", "value")
    out = spark.read.parquet(log)
    return out.select("series_id", F.col("prediction_date").cast("date"), "predicted_for_date", "actual_today",
                      "predicted", "lower", "upper")


@register("stream_score_state", STREAM_SCORE_SQL, doubles="actual_today predicted lower upper")
def q_stream_score_state(spark, sf_dir):
    """The same days scored from a tail in the state store, in three deliveries, with AR(1) fitted on the history."""
    p = p2_filled(spark, sf_dir).withColumn("_last", F.max("date").over(Window.partitionBy(*K)))
    p = materialize(p.withColumn("_ahead", F.datediff("_last", "date")), "score_days")
    history, arriving, log = p.where(F.col("_ahead") >= HOLDOUT_DAYS).select(*K, "date", "value"), scratch_path(spark, "arriving_days"), scratch_path(spark, "score_state")
    coefs = materialize(ar_fit(history, K, "date", "value").withColumnRenamed("phi", "phi_1"), "score_coefs")
    for from_, to in ((HOLDOUT_DAYS - 1, 20), (19, 10), (9, 0)):
        p.where(F.col("_ahead").between(to, from_)).select(*K, "date", "value").write.mode("append").parquet(arriving)
        stream_score_state(spark, arriving, "series_id string, date date, value double", history, coefs, K, "date", "value", log_path=log)
    return spark.read.parquet(log).select("series_id", F.col("prediction_date").cast("date"), "predicted_for_date", "actual_today", "predicted", "lower", "upper")
