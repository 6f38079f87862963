"""Streams that keep their own state: finished days by event-time window, and scoring from a tail held for each series.

``stream_finished_days`` writes every day once, when the watermark has closed it.
``stream_score_state`` holds the last days of each series in the state store instead of a table that every
batch rewrites; a series that has been silent for the length of its tail is dropped by a timer.
"""

from __future__ import annotations

import datetime as dt
import math

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from panelstack.functions.bands import clip, nan_to_null
from panelstack.operators.forecast import Z95
from panelstack.operators.windows import last_n
from panelstack.session import scratch_path
from panelstack.sources.writers import upsert_predictions
from panelstack.streaming.daily import file_stream

#: Days of a series that are kept.
TAIL = 60


def stream_finished_days(spark: SparkSession, source_dir: str, schema: str, keys: list[str], ts: str, measures: list[str], out_path: str | None = None,
                         watermark: str = "2 days", offset_hours: int = 0, scale: int = 2, file_glob: str | None = None, max_files: int | None = None) -> str:
    """Append one row for each (series, local day) to a parquet table once the day is over by the watermark; returns its path.

    Days are event-time windows of the local clock (UTC + ``offset_hours``).  A reading that comes after its day was
    closed is dropped; days that are still open are not written, and follow when the stream is started again on the same ``out_path``.
    """
    out_path = out_path or scratch_path(spark, "finished_days")
    rows = file_stream(spark, source_dir, schema, file_glob, max_files).withColumn("_t", F.col(ts).cast("timestamp"))
    day = F.window("_t", "1 day", startTime=f"{-offset_hours % 24} hours")
    means = (rows.withWatermark("_t", watermark).groupBy(*keys, day.alias("_w")).agg(*[F.round(F.avg(nan_to_null(m)), scale).alias(m) for m in measures])
             .select(*keys, F.to_date(F.col("_w.start") + F.expr(f"INTERVAL {offset_hours} HOURS")).alias("day"), *measures))
    q = (means.writeStream.outputMode("append").format("parquet").option("path", out_path).option("checkpointLocation", out_path + "_checkpoint")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return out_path


class TailScorer(StatefulProcessor):
    """Keeps (day, value) of a series' last TAIL days and forecasts the day after each day that arrives, by AR(p)."""

    def __init__(self, keys: list[str], t: str, v: str, p: int):
        self.names, self.t, self.v, self.p = keys, t, v, p

    def init(self, handle) -> None:
        self.handle = handle
        self.days = handle.getMapState("days", "day date", "value double")

    def _keep(self, rows: list[tuple[dt.date, float]]) -> None:
        for day, value in rows:
            self.days.updateValue((day,), (None if value is None or math.isnan(value) else float(value),))
        seen = [k[0] for k in self.days.keys()]
        for day in seen:
            if (max(seen) - day).days >= TAIL:
                self.days.removeKey((day,))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        quiet = dt.datetime.combine(max(seen) + dt.timedelta(days=TAIL), dt.time(), dt.UTC)
        self.handle.registerTimer(int(quiet.timestamp() * 1000))

    def handleInitialState(self, key, state: pd.DataFrame, timers) -> None:
        self._keep(list(zip(state[self.t], state[self.v], strict=True)))

    def handleInputRows(self, key, rows, timers):
        new = pd.concat(list(rows)).sort_values([self.t, self.v], na_position="first").drop_duplicates(self.t, keep="last")
        fit = new.iloc[0]
        self._keep(list(zip(new[self.t], new[self.v], strict=True)))
        held = {k[0]: v[0] for k, v in self.days.iterator()}
        out = []
        for day, value in zip(new[self.t], new[self.v], strict=True):
            past = [held.get(day - dt.timedelta(days=i)) for i in range(self.p)]
            point = None if None in past else float(fit["intercept"]) + sum(float(fit[f"phi_{i + 1}"]) * x for i, x in enumerate(past))
            band = None if point is None else Z95 * float(fit["sigma"])
            out.append((*key, day, day + dt.timedelta(days=1), value, point, None if point is None else point - band, None if point is None else point + band, len(held)))
        yield pd.DataFrame(out, columns=[*self.names, "prediction_date", "predicted_for_date", "actual_today", "predicted", "lower", "upper", "days_held"])

    def handleExpiredTimer(self, key, timers, expired):
        self.days.clear()
        yield pd.DataFrame(columns=[*self.names, "prediction_date", "predicted_for_date", "actual_today", "predicted", "lower", "upper", "days_held"])

    def close(self) -> None:
        pass


def stream_score_state(spark: SparkSession, source_path: str, schema: str, history: DataFrame, coefs: DataFrame, keys: list[str], t: str, v: str, p: int = 1,
                       log_path: str | None = None, watermark: str = "60 days", lo: float = 0.0, hi: float = 500.0, max_files: int | None = None) -> str:
    """Score arriving days by AR(p) (``coefs``: keys, intercept, phi_1 .., sigma) from a tail kept in the state store; upserts the log.

    A day that comes again, or late, replaces its value in the tail and its row in the log.  A day whose lags are not in
    the tail has a null forecast; a series without coefficients is not scored.  State lives in the RocksDB store.
    """
    log_path = log_path or scratch_path(spark, "score_state")
    store = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(store, None)
    spark.conf.set(store, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    types = dict(history.dtypes)
    out = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", prediction_date date, predicted_for_date date, actual_today double, predicted double, lower double, upper double, days_held int"
    rows = file_stream(spark, source_path, schema, max_files=max_files).withColumn("_t", F.col(t).cast("timestamp")).withWatermark("_t", watermark)
    scored = (rows.join(coefs.select(*keys, "intercept", *[f"phi_{i}" for i in range(1, p + 1)], "sigma"), keys).groupBy(*keys)
              .transformWithStateInPandas(TailScorer(keys, t, v, p), out, "Update", "EventTime", initialState=last_n(history, keys, t, TAIL).select(*keys, t, v).groupBy(*keys)))

    def upsert(batch: DataFrame, epoch_id: int) -> None:
        upsert_predictions(spark, batch.withColumn("predicted", clip("predicted", lo, hi)), log_path, [*keys, "prediction_date"])

    try:
        q = (scored.writeStream.outputMode("update").option("checkpointLocation", log_path + "_checkpoint").foreachBatch(upsert).trigger(availableNow=True).start())
        q.awaitTermination()
    finally:
        spark.conf.unset(store) if before is None else spark.conf.set(store, before)
    return log_path
