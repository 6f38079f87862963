from pyspark.sql import functions as F

from panelstack.operators.clean import align_features, drop_columns, numeric_columns, relabel
from panelstack.operators.combine import stations_in_bounds
from panelstack.sources.readers import annotate_schema, read_observations
from panelstack.sources.writers import write_panel, write_report


def test_schema_helpers(spark):
    df = spark.createDataFrame([("2024-01-01", 1.0, 2, "x")], "date string, pm2_5 double, n int, s string")
    assert drop_columns(df, ["s", "missing"]).columns == ["date", "pm2_5", "n"]
    assert numeric_columns(df) == ["pm2_5", "n"]
    assert numeric_columns(df, exclude=["n"]) == ["pm2_5"]
    assert align_features(df, ["n", "missing", "pm2_5"], keep=["date"]).columns == ["date", "n", "pm2_5"]
    assert relabel(df, {"pm2_5": "PM2.5", "nope": "x"}).columns == ["date", "PM2.5", "n", "s"]
    a = annotate_schema(df, {"pm2_5": {"unit": "ug/m3", "description": "fine particles"}})
    assert a.schema["pm2_5"].metadata == {"unit": "ug/m3", "description": "fine particles"}


def test_panel_and_report_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", "2024-01-01", 1.5, "train"), ("a", "2024-01-02", None, "test")],
                               "series_id string, date string, value double, split string")
    p = str(tmp_path / "panel")
    write_panel(df, p, partition_by=["split"])
    back = read_observations(spark, p)
    assert back.count() == 2 and dict(back.dtypes)["date"] == "date"
    assert back.where("split = 'test'").first().value is None
    r = str(tmp_path / "report")
    write_report(df.groupBy("split").count(), r)
    csv = spark.read.option("header", True).csv(r)
    assert sorted(x.split for x in csv.collect()) == ["test", "train"]


def test_stations_in_bounds(spark):
    st = spark.createDataFrame([("in", 10.8, 106.7), ("out", 21.0, 105.8)], "name string, lat double, lon double")
    assert [r.name for r in stations_in_bounds(st, 10.35, 11.15, 106.35, 107.05).collect()] == ["in"]


def test_model_round_trip(spark, tmp_path):
    from panelstack.operators.learn import ridge
    from panelstack.sources.models import load_model, save_model
    df = spark.range(50).select(F.col("id").cast("double").alias("x"), (F.col("id") * 2.0 + 1).alias("y"))
    m = ridge(df, ["x"], "y", alpha=1.0)
    save_model(spark, m, str(tmp_path / "m"), ["x"], {"rmse": 0.1}, "ridge")
    m2, feats, meta = load_model(spark, str(tmp_path / "m"))
    assert feats == ["x"]
    a = m.transform(df).select("prediction").collect()
    b = m2.transform(df).select("prediction").collect()
    assert a == b


def test_read_checked_keeps_every_line_once(spark, tmp_path):
    from panelstack.sources.readers import read_checked
    lines = ["series,day,value", "a,2024-01-01,1.5", "a,2024-01-02,", "b,2024-02-30,2", "b,2024-01-03,x y", "b,soon,late", "c,2024-01-04", "c,2024-01-05,1,2", '"d, e",2024-01-06,3']
    path = tmp_path / "obs"
    path.mkdir()
    (path / "part.csv").write_text("\n".join(lines) + "\n")
    rows, rejects = read_checked(spark, str(path), "series STRING, day DATE, value DOUBLE")
    assert sorted((r.series, str(r.day), r.value) for r in rows.collect()) == [("a", "2024-01-01", 1.5), ("a", "2024-01-02", None), ("d, e", "2024-01-06", 3.0)]
    assert sorted(tuple(r) for r in rejects.collect()) == [("b,2024-01-03,x y", "value", "value"), ("b,2024-02-30,2", "value", "day"), ("b,soon,late", "value", "day,value"), ("c,2024-01-04", "fields", ""), ("c,2024-01-05,1,2", "fields", "")]
    assert rows.count() == 3 and rejects.count() == 5


def test_kde_series_equals_the_plain_sum(spark):
    import numpy as np

    from panelstack.operators.stats import expansion_terms, kde
    r = np.random.default_rng(4)
    series = {"a": r.normal(50, 10, 700), "far": np.r_[r.normal(0, 1, 300), [1e5, -3e4]], "flat": np.full(5, 2.0), "two": np.array([1.0, 2.0])}
    df = spark.createDataFrame([(k, float(x)) for k, xs in series.items() for x in xs] + [("a", None)], "series_id string, value double")
    got = {}
    for row in kde(df, ["series_id"], "value", grid=120, bins=10).collect():
        got.setdefault(row.series_id, {})[row.grid_index] = row.density_count
    for k, xs in series.items():
        n, lo, hi = len(xs), xs.min(), xs.max()
        bw = n**-0.2 * xs.std(ddof=1)
        if k == "flat":
            assert set(got[k].values()) == {None}
            continue
        at = lo + np.arange(120) * (hi - lo) / 119
        plain = np.exp(-0.5 * ((at[:, None] - xs) / bw) ** 2).sum(axis=1) / (bw * np.sqrt(2 * np.pi)) * (hi - lo) / 10
        assert np.abs(np.array([got[k][i] for i in range(120)]) - plain).max() < 1e-8
    assert expansion_terms(1e-12) < expansion_terms(1e-15) <= 25
