"""Streams over several micro-batches: late rows, empty files, replays."""

import datetime as dt
import os
import time

import pytest
from pyspark.sql import functions as F

from panelstack.session import scratch_path
from panelstack.streaming.daily import daily_mean, model_scorer, stream_daily_mean, stream_dedup, stream_score

K = ["series_id"]
SCHEMA = "series_id string, ts timestamp, value double"
DAY0 = dt.datetime(2024, 3, 1, tzinfo=dt.UTC)


def as_files(spark, batches, schema):
    """One parquet file a batch in one folder, in time order."""
    path = scratch_path(spark, "arriving")
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        files = [f"{path}/{f}" for f in os.listdir(path) if f.endswith(".parquet")]
        newest = max(files, key=os.path.getmtime)
        os.utime(newest, (time.time() - 1000 + 10 * i,) * 2)
    return path


def reading(s, day, hour, value):
    return (s, DAY0 + dt.timedelta(days=day, hours=hour), value)


@pytest.fixture(scope="module")
def arriving(spark):
    batches = [
        [reading("a", 0, 1, 10.0), reading("a", 0, 2, 20.0), reading("b", 0, 5, 1.0)],
        [],
        [reading("a", 1, 1, 30.0), reading("a", 0, 9, 30.0), reading("b", 1, 0, None)],  # one row of the day before, in time
        [reading("a", 9, 1, 5.0)],
        [reading("a", 9, 2, 7.0)],  # late rows are measured against the watermark of the batch before
        [reading("a", 0, 3, 999.0), reading("b", 9, 1, 2.0)],  # the first comes after the watermark
    ]
    return batches, as_files(spark, batches, SCHEMA)


def test_daily_mean_stream_equals_batch_without_the_late_row(spark, arriving):
    batches, path = arriving
    out = stream_daily_mean(spark, path, SCHEMA, K, "ts", ["value"], watermark="2 days", max_files=1)
    got = {(r.series_id, str(r.day)): r.value for r in spark.read.parquet(out).collect()}
    rows = [r for b in batches for r in b if r[2] != 999.0]
    expected = daily_mean(spark.createDataFrame(rows, SCHEMA), K, "ts", ["value"])
    assert got == {(r.series_id, str(r.day)): r.value for r in expected.collect()}
    again = stream_daily_mean(spark, path, SCHEMA, K, "ts", ["value"], watermark="2 days", max_files=1, out_path=out)
    assert {(r.series_id, str(r.day)): r.value for r in spark.read.parquet(again).collect()} == got


def test_dedup_follows_the_watermark(spark):
    batches = [[reading("a", 0, 1, 1.0), reading("a", 0, 2, 2.0)], [reading("a", 0, 20, 3.0)], [reading("b", 10, 0, 1.0)], [reading("c", 20, 0, 1.0)], [reading("a", 20, 1, 4.0)]]
    out = stream_dedup(spark, as_files(spark, batches, SCHEMA), SCHEMA, K, "ts", watermark="1 day", max_files=1)
    counts = {r.series_id: r["count"] for r in spark.read.parquet(out).groupBy("series_id").count().collect()}
    assert counts == {"a": 2, "b": 1, "c": 1}  # once in the first days, and again once forgotten


DAILY = "series_id string, date date, value double"


def days(first, last, s="a"):
    return [(s, (DAY0 + dt.timedelta(days=i)).date(), 50.0 + (i * 7) % 13) for i in range(first, last)]


def test_scoring_stream_carries_state_over_empty_batches(spark):
    history = spark.createDataFrame(days(0, 80) + days(0, 80, "b"), DAILY)
    path = as_files(spark, [days(80, 81), [], days(81, 82) + days(80, 81, "b"), days(82, 84)], DAILY)
    log = stream_score(spark, path, DAILY, history, K, "date", "value", max_files=1)
    rows = {(r.series_id, str(r.prediction_date)): r.predicted for r in spark.read.parquet(log).collect()}
    assert len(rows) == 5
    one = stream_score(spark, path, DAILY, history, K, "date", "value")  # all files in one batch
    assert {(r.series_id, str(r.prediction_date)): r.predicted for r in spark.read.parquet(one).collect()} == pytest.approx(rows)
    again = stream_score(spark, path, DAILY, history, K, "date", "value", max_files=1, log_path=log)
    assert {(r.series_id, str(r.prediction_date)): r.predicted for r in spark.read.parquet(again).collect()} == rows
    states = [d for d in os.listdir(log + "_tail") if d.startswith("batch=")]
    assert len(states) <= 2


def test_scoring_stream_with_the_fitted_model(spark):
    from panelstack.operators.learn import ridge, score_regression
    from panelstack.plans.features import TARGET, FeaturePipeline

    history = spark.createDataFrame(days(0, 120), DAILY)
    pipe = FeaturePipeline(K, "date", "value", [])
    train = pipe.fit_transform(history).where(F.col("split") == "train")
    model = ridge(train, pipe.features, TARGET)
    path = as_files(spark, [days(120, 121), days(121, 123)], DAILY)
    log = stream_score(spark, path, DAILY, history, K, "date", "value", scorer=model_scorer(pipe, model, K, "date"), max_files=1)
    got = {str(r.prediction_date): r.predicted for r in spark.read.parquet(log).collect()}
    whole = pipe.transform(spark.createDataFrame(days(0, 123), DAILY))
    batch = {str(r.date): r.predicted for r in score_regression(model, whole, ["date"]).collect()}
    assert len(got) == 3 and got == {d: batch[d] for d in got}


def test_finished_days_come_once_and_late_rows_are_lost(spark, arriving):
    from panelstack.streaming.state import stream_finished_days
    batches, path = arriving
    out = stream_finished_days(spark, path, SCHEMA, K, "ts", ["value"], max_files=1)
    got = sorted((r.series_id, str(r.day), r.value) for r in spark.read.parquet(out).collect())
    # Day 9 is still open; the row of 999 came after day 0 was closed.
    assert got == [("a", "2024-03-01", 20.0), ("a", "2024-03-02", 30.0), ("b", "2024-03-01", 1.0), ("b", "2024-03-02", None)]
    again = stream_finished_days(spark, path, SCHEMA, K, "ts", ["value"], max_files=1, out_path=out)
    assert sorted((r.series_id, str(r.day), r.value) for r in spark.read.parquet(again).collect()) == got
    # Local days: 18:00 UTC is the next day at UTC+7.
    path = as_files(spark, [[reading("a", 0, 16, 1.0), reading("a", 0, 18, 5.0)], [reading("a", 9, 0, 0.0)]], SCHEMA)
    local = stream_finished_days(spark, path, SCHEMA, K, "ts", ["value"], offset_hours=7, max_files=1)
    assert sorted((str(r.day), r.value) for r in spark.read.parquet(local).collect()) == [("2024-03-01", 1.0), ("2024-03-02", 5.0)]


def test_state_scoring_over_empty_late_and_replayed_batches(spark):
    from panelstack.streaming.state import stream_score_state
    day = dt.date(2024, 1, 1)
    schema = "series_id string, date date, value double"

    def rows(days, f=float):
        return [(s, day + dt.timedelta(days=d), f(d) + (100.0 if s == "b" else 0.0)) for s in ("a", "b") for d in days]

    history = spark.createDataFrame(rows(range(90)), schema)
    coefs = spark.createDataFrame([("a", 1.0, 0.5, 0.25, 2.0), ("b", 2.0, 0.1, 0.2, 1.0)], "series_id string, intercept double, phi_1 double, phi_2 double, sigma double")
    batches = [rows([90]), [], *[rows([d]) for d in range(91, 120)], rows([118], lambda d: 7.0), rows([121]), [("c", day, 1.0)]]
    log = stream_score_state(spark, as_files(spark, batches, schema), schema, history, coefs, K, "date", "value", p=2, max_files=1, hi=1000.0)
    got = {(r.series_id, r.prediction_date): r for r in spark.read.parquet(log).collect()}
    assert len(got) == 2 * 31 and {k[0] for k in got} == {"a", "b"}
    value = {d: float(d) for d in range(120)} | {118: 7.0, 121: 121.0}
    for d in (90, 117, 118):
        r = got["a", day + dt.timedelta(days=d)]
        before = value[d - 1]
        assert (r.predicted, r.upper - r.predicted) == pytest.approx((1.0 + 0.5 * value[d] + 0.25 * before, 1.96 * 2.0))
    assert got["a", day + dt.timedelta(days=121)].predicted is None  # day 120 never came
    # The state does not grow: 60 days a series, whatever came before.
    assert {r.days_held for r in got.values()} <= {59, 60}
