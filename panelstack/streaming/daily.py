"""Daily reduction of raw readings, in batch and in Structured Streaming form.

``daily_mean`` is the batch operator; ``stream_daily_mean`` runs the same
aggregate incrementally over a file source with a watermark and upserts the
per-day results (update mode + ``foreachBatch``), so replaying the source gives
the same table as the batch job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelstack.functions.bands import nan_to_null
from panelstack.session import drop_path, materialize, scratch_path


def daily_mean(df: DataFrame, keys: list[str], ts: str, measures: list[str], scale: int = 2,
               tz: str | None = None, day_col: str = "day") -> DataFrame:
    """Mean of the non-null readings per (series, local day), rounded; an all-null day gives null.

    ``tz`` converts UTC stamps to local wall-clock time before taking the date.
    A plain hash aggregate: partial sums are combined map side, so a hot series
    ships one partial row per task and day.
    """
    t = F.col(ts)
    if tz:
        t = F.from_utc_timestamp(t, tz)
    return df.groupBy(*keys, F.to_date(t).alias(day_col)).agg(
        *[F.round(F.avg(nan_to_null(m)), scale).alias(m) for m in measures])


def file_stream(spark: SparkSession, source_dir: str, schema: str, file_glob: str | None = None,
                max_files: int | None = None) -> DataFrame:
    """Parquet file-stream source over a directory, optionally restricted to matching file names
    and to so many files a micro-batch (the oldest files first)."""
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if file_glob:
        reader = reader.option("pathGlobFilter", file_glob)
    return reader.parquet(source_dir)


def stream_daily_mean(spark: SparkSession, source_dir: str, schema: str, keys: list[str], ts: str,
                      measures: list[str], out_path: str | None = None, watermark: str = "2 days",
                      tz: str | None = None, file_glob: str | None = None, scale: int = 2,
                      max_files: int | None = None) -> str:
    """Daily mean per series from a parquet file stream; returns the output table path.

    The day bucket (local date of the reading, as in :func:`daily_mean`) is the
    event-time column: the watermark lets the engine evict finished days and drop
    rows that arrive later than ``watermark``.  Update mode + ``foreachBatch``
    upserts each changed (series, day), so a replay is idempotent and the table
    equals the batch result.
    """
    from panelstack.sources.writers import upsert_predictions

    out_path = out_path or scratch_path(spark, "stream_daily_mean")
    t = F.col(ts)
    if tz:
        t = F.from_utc_timestamp(t, tz)
    src = file_stream(spark, source_dir, schema, file_glob, max_files)
    agg = (src.withColumn("_day", F.to_date(t).cast("timestamp"))
           .withWatermark("_day", watermark)
           .groupBy(*keys, "_day")
           .agg(*[F.round(F.avg(nan_to_null(m)), scale).alias(m) for m in measures])
           .select(*keys, F.to_date("_day").alias("day"), *measures))

    def upsert(batch: DataFrame, epoch_id: int) -> None:
        upsert_predictions(spark, batch, out_path, keys + ["day"], partition_col="day")

    q = (agg.writeStream.outputMode("update").option("checkpointLocation", out_path + "_checkpoint")
         .foreachBatch(upsert).trigger(availableNow=True).start())
    q.awaitTermination()
    return out_path


def stream_dedup(spark: SparkSession, source_dir: str, schema: str, keys: list[str], ts: str,
                 watermark: str = "1 day", out_path: str | None = None, file_glob: str | None = None,
                 max_files: int | None = None) -> str:
    """Each key once within the watermark delay (``dropDuplicatesWithinWatermark``), appended to parquet.

    A key is remembered until the watermark passes its event time plus the delay; after
    that a later row of the key is a new one.  Within one micro-batch the watermark
    does not move, so every key of a batch comes once at most.
    """
    out_path = out_path or scratch_path(spark, "stream_dedup")
    src = file_stream(spark, source_dir, schema, file_glob, max_files).withColumn("_event_time", F.col(ts).cast("timestamp"))
    d = src.withWatermark("_event_time", watermark).dropDuplicatesWithinWatermark(keys).drop("_event_time")
    q = (d.writeStream.outputMode("append").format("parquet").option("path", out_path)
         .option("checkpointLocation", out_path + "_checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    return out_path


def ar1_scorer(spark: SparkSession, history: DataFrame, keys: list[str], t: str, v: str, path: str):
    """Scores days by a per-series AR(1) fitted on the history; the coefficients are saved at ``path`` once."""
    from panelstack.operators.forecast import ar1_score_rows, ar_fit
    from panelstack.sources.writers import path_exists

    if not path_exists(spark, path):  # a restarted stream scores with what it scored with before
        ar_fit(history, keys, t, v).write.mode("overwrite").parquet(path)
    coefs = spark.read.parquet(path)
    return lambda frame: ar1_score_rows(frame, coefs, keys, t, v)


def model_scorer(pipe, model, keys: list[str], t: str):
    """Scores days by a fitted feature pipeline and regression model (both may be loaded from disk)."""
    from panelstack.operators.learn import score_regression

    def score(frame: DataFrame) -> DataFrame:
        out = score_regression(model, pipe.transform(frame), [*keys, t])
        return out.withColumnRenamed(t, "prediction_date").withColumn("predicted_for_date", F.date_add("prediction_date", 1))

    return score


def stream_score(spark: SparkSession, source_path: str, schema: str, history: DataFrame, keys: list[str],
                 t: str, v: str, log_path: str | None = None, tail: int = 60, scorer=None, max_files: int | None = None) -> str:
    """Score arriving days on each series' tail and upsert the log.

    ``scorer`` maps the tail frame to rows (keys, prediction_date, ...); default AR(1).
    State between micro-batches is the last ``tail`` rows of every series, not the
    whole history: it is built once, and each micro-batch reads the state left by
    the previous batch id, appends its new days, scores them, upserts the log keyed
    by (series, prediction_date) and writes the new state under its own batch id.
    A batch without rows hands the state on.  A replayed batch re-reads the same input
    state and overwrites the same outputs, so the log and the state stay idempotent;
    states older than the one a replay needs are removed.
    """
    from panelstack.operators.combine import append_and_tail
    from panelstack.operators.windows import last_n
    from panelstack.sources.writers import path_exists, upsert_predictions

    log_path = log_path or scratch_path(spark, "stream_score")
    state_path = log_path + "_tail"
    scorer = scorer or ar1_scorer(spark, history, keys, t, v, log_path + "_coefs")
    if not path_exists(spark, state_path):
        last_n(history, keys, t, tail).drop("recency_rank").write.mode("overwrite").parquet(f"{state_path}/batch=-1")

    def score(batch: DataFrame, epoch_id: int) -> None:
        batch = batch.persist()  # used for the frame and for the days that arrived
        state = spark.read.parquet(f"{state_path}/batch={epoch_id - 1}")
        frame = materialize(append_and_tail(state, batch, keys, t, tail), "stream_frame")
        if not batch.isEmpty():
            arrived = batch.select(*keys, F.col(t).alias("prediction_date")).distinct()
            new_rows = scorer(frame).join(arrived, on=keys + ["prediction_date"], how="left_semi")
            upsert_predictions(spark, new_rows, log_path, keys + ["prediction_date"])
        last_n(frame, keys, t, tail).drop("recency_rank").write.mode("overwrite").parquet(f"{state_path}/batch={epoch_id}")
        drop_path(spark, f"{state_path}/batch={epoch_id - 2}")
        batch.unpersist()

    q = (file_stream(spark, source_path, schema, max_files=max_files).writeStream
         .option("checkpointLocation", log_path + "_checkpoint").foreachBatch(score)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return log_path
