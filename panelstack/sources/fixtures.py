"""Panels derived from the driver tables.

* P1 ``events``   -> hourly readings: series = event_type, hour, value = avg(value)
* P2 ``orders``   -> daily index with gaps: series = o_orderpriority, value = avg(o_totalprice)/1000
* P3 ``lineitem`` -> multi-measure daily table: series = l_returnflag, four daily means

Only the columns each panel needs are selected, so the parquet scan reads a
pruned schema; the daily aggregation is a hash aggregate with map-side partial
combine, so a hot series costs one partial row per (task, day), not one per input row.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelstack.sources.readers import read_dimension

P3_MEASURES = ["quantity", "extendedprice", "discount", "tax"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def dimension(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_dimension(spark, os.path.join(sf_dir, f"{name}.parquet"), fmt="parquet")


def hourly_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw readings: (series_id, ts, value) straight from ``events``."""
    ev = table(spark, sf_dir, "events")
    return ev.select(F.col("event_type").alias("series_id"), F.col("ts"), F.col("value"))


def p1_hourly_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P1: one row per (series, hour) with the hourly mean."""
    raw = hourly_readings(spark, sf_dir)
    return (raw.groupBy("series_id", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"))
            .agg(F.avg("value").alias("value")))


def p2_daily_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P2: (series_id, date, value) with real calendar gaps."""
    o = table(spark, sf_dir, "orders")
    return (o.groupBy(F.col("o_orderpriority").alias("series_id"), F.to_date("o_orderdate").alias("date"))
            .agg((F.avg("o_totalprice") / 1000.0).alias("value")))


def p3_measure_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P3: (series_id, date, quantity, extendedprice, discount, tax) daily means."""
    li = table(spark, sf_dir, "lineitem")
    return (li.groupBy(F.col("l_returnflag").alias("series_id"), F.to_date("l_shipdate").alias("date"))
            .agg(F.avg("l_quantity").alias("quantity"),
                 F.avg("l_extendedprice").alias("extendedprice"),
                 F.avg("l_discount").alias("discount"),
                 F.avg("l_tax").alias("tax")))


def region_daily_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders keyed by customer region: the dimension join of the series key.

    All joins are left to the planner: it broadcasts a dimension where its file or
    measured size allows, and nothing is run while the plan is built.
    """
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_totalprice")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n = dimension(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    r = dimension(spark, sf_dir, "region").select("r_regionkey", "r_name")
    dims = n.join(r, n.n_regionkey == r.r_regionkey).select("n_nationkey", "r_name")
    j = (o.join(c, o.o_custkey == c.c_custkey)
         .join(dims, F.col("c_nationkey") == F.col("n_nationkey")))
    return (j.groupBy(F.col("r_name").alias("series_id"), F.to_date("o_orderdate").alias("date"))
            .agg((F.avg("o_totalprice") / 1000.0).alias("value"), F.count(F.lit(1)).alias("n_orders")))
