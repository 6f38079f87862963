"""Feature pipeline (M19), learners (M1-M12, M15), explanations (M13-M14, F1, F3) and per-series
autoregressive baselines (M16-M18)."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelstack.functions.bands import aqi_band, aqi_band_code, aqi_class
from panelstack.functions.calendar import next_day
from panelstack.operators.boost import CLASS_PRESETS, REGRESSION_PRESETS, boost, score_boosted
from panelstack.operators.clean import align_features, fallback_row
from panelstack.operators.combine import append_and_tail
from panelstack.operators.grid import interpolate, to_daily_grid
from panelstack.operators.explain import (
    background_means, contribution_summary, fit_linear_moments, linear_contributions,
)
from panelstack.operators.forecast import (
    ar1_multistep, ar1_walk_forward, ar_p_walk_forward, dickey_fuller,
)
from panelstack.operators.learn import (
    FOREST_PRESETS, blend, blend_sweep, boosted_regressor, cv_evaluate, decision_tree_regressor, feature_scores,
    grid_search, models_agree, random_forest_classifier, random_forest_regressor, ridge, score_class,
    score_regression, side_by_side, stratified_folds,
)
from panelstack.operators.metrics import balanced_weights, classification_metrics, regression_metrics
from panelstack.operators.ranking import explain_top, leaderboard, top_features
from panelstack.operators.trees import read_trees, tree_contributions
from panelstack.operators.windows import last_n, time_series_folds, time_split
from panelstack.plans.features import (
    CYCLIC, FLAGS, LAGS, TARGET, TARGET_CLASS, WINDOWS, FUNCS, DIFFS, FeaturePipeline, scaled_names,
)
from panelstack.plans.panels import K, p2_filled
from panelstack.plans.q_basic import band_advice
from panelstack.plans.q_stats import BASE_SQL, P3_SPLIT, _metrics_sql, _p3_split, baseline_predictions
from panelstack.plans.registry import register
from panelstack.plans.sqlparts import P2I, P3, W, aqi_class as sql_class, band_code, clip, grid, interp
from panelstack.session import materialize, scratch_path
from panelstack.sources.fixtures import p3_measure_panel, region_daily_panel
from panelstack.sources.models import load_model, save_model
from panelstack.sources.readers import build_hourly_payload, explode_hourly
from panelstack.sources.writers import latest_json, upsert_predictions
from panelstack.streaming.daily import daily_mean

T = "date"
MEASURES = ["n_orders"]

# --- M19 feature pipeline on the region-keyed order panel (value + one extra measure) ---------------

REGION = ("region_p AS (SELECT r.r_name AS series_id, CAST(o.o_orderdate AS DATE) AS date, "
          "avg(o.o_totalprice) / 1000.0 AS value, CAST(count(*) AS DOUBLE) AS n_orders FROM orders o "
          "JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey "
          "JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY 1, 2)")


def _feature_sql() -> str:
    lags = [f"lag(value, {k}) OVER ({W}) AS lag_{k}" for k in LAGS]
    fn = {"mean": "avg", "std": "stddev_samp", "max": "max", "min": "min"}
    rolls = []
    for w in WINDOWS:
        frame = f"({W} ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING)"
        rolls += [f"CASE WHEN count(value) OVER {frame} = {w} THEN {fn[f]}(value) OVER {frame} END AS rolling_{f}_{w}"
                  for f in FUNCS]
    diffs = [f"value - lag(value, {k}) OVER ({W}) AS diff_{k}" for k in DIFFS]
    cyc = [f"{fnc}(2 * pi() * {x} / {n}) AS {name}_{fnc}" for name, x, n in
           (("month", "month(date)", 12), ("weekday", "(isodow(date) - 1)", 7), ("day_of_year", "dayofyear(date)", 365))
           for fnc in ("sin", "cos")]
    flags = ["CAST(isodow(date) - 1 >= 5 AS INTEGER) AS is_weekend",
             "CAST(month(date) IN (12, 1, 2, 3, 4) AS INTEGER) AS is_dry_season"]
    feats = MEASURES + [f"lag_{k}" for k in LAGS] + [f"rolling_{f}_{w}" for w in WINDOWS for f in FUNCS] + \
        [f"diff_{k}" for k in DIFFS] + CYCLIC + FLAGS
    complete = " AND ".join(f"{c} IS NOT NULL" for c in feats + [TARGET])
    scaled = scaled_names(MEASURES)
    fits = ", ".join(f"quantile_cont({c}, 0.5) AS {c}__m, quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) AS {c}__r"
                     for c in scaled)
    outs = ", ".join(f"({c} - {c}__m) / CASE WHEN {c}__r = 0 THEN 1.0 ELSE {c}__r END AS {c}" for c in scaled)
    fence = ("CASE WHEN n_orders IS NOT NULL THEN least(greatest(n_orders, greatest(q1 - 3.0 * (q3 - q1), 0.0)), "
             "q3 + 3.0 * (q3 - q1)) END")
    return f"""
WITH {REGION}, {grid('region_p', 'g', 'value,n_orders')}, {interp('g', 'gi', ['value', 'n_orders'])},
f AS (SELECT series_id, date, n_orders, {', '.join(lags + rolls + diffs + cyc + flags)},
      lead(value, 1) OVER ({W}) AS {TARGET} FROM gi),
c AS (SELECT *, {sql_class(TARGET)} AS {TARGET_CLASS} FROM f WHERE {complete}),
s AS (SELECT *, CASE WHEN row_number() OVER ({W}) > count(*) OVER (PARTITION BY series_id)
      - ceil(count(*) OVER (PARTITION BY series_id) * 0.2) THEN 'test' ELSE 'train' END AS split FROM c),
fen AS (SELECT quantile_cont(n_orders, 0.25) AS q1, quantile_cont(n_orders, 0.75) AS q3 FROM s WHERE split = 'train'),
wz AS (SELECT s.* REPLACE ({fence} AS n_orders) FROM s, fen),
sc AS (SELECT {fits} FROM wz WHERE split = 'train')
SELECT series_id, date, split, {TARGET}, {TARGET_CLASS}, {outs}, {', '.join(CYCLIC + FLAGS)} FROM wz, sc"""


def feature_panel(spark, sf_dir):
    pipe = FeaturePipeline(K, T, "value", MEASURES)
    return pipe.fit_transform(region_daily_panel(spark, sf_dir)), pipe


@register("feature_panel", _feature_sql(),
          doubles=[TARGET] + scaled_names(MEASURES) + CYCLIC, ints=[TARGET_CLASS] + FLAGS)
def q_feature_panel(spark, sf_dir):
    return feature_panel(spark, sf_dir)[0]


_held: list = []  # the training panel of the query built last


def _train_test(spark, sf_dir):
    """Train/test parts of the fitted feature panel.

    Learners scan train many times, so it is persisted; the one of the query before is let go, so that one panel
    at most is held (a plan that still needs it reads the written panel again).
    """
    while _held:
        before = _held.pop()
        if before.sparkSession is spark:
            before.unpersist()
    panel, pipe = feature_panel(spark, sf_dir)
    train = panel.where(F.col("split") == "train").persist()
    _held.append(train)
    return train, panel.where(F.col("split") == "test"), pipe


# --- learners (rows-only checks: model fits have no SQL twin) -------------------------------------

@register("top_features")
def q_top_features(spark, sf_dir):
    train, _, pipe = _train_test(spark, sf_dir)
    model = ridge(train, pipe.features, TARGET, alpha=10.0)
    names, scores = zip(*feature_scores(model, pipe.features))
    return top_features(spark, list(names), list(scores), k=20)


@register("ridge_score")
def q_ridge_score(spark, sf_dir):
    train, test, pipe = _train_test(spark, sf_dir)
    model = ridge(train, pipe.features, TARGET, alpha=10.0)
    scored = score_regression(model, test, ["series_id", T, TARGET])
    return regression_metrics(scored.select(F.col(TARGET).alias("y"), F.col("predicted").alias("yhat"),
                                            F.lit("ridge").alias("model")), ["model"])


def _test_metrics(test, fits: dict) -> "DataFrame":
    allp = None
    for name, m in fits.items():
        p = m.transform(test).select(F.col(TARGET).alias("y"), F.col("prediction").alias("yhat"), F.lit(name).alias("model"))
        allp = p if allp is None else allp.unionByName(p)
    return regression_metrics(allp, ["model"])


@register("tree_regressor")
def q_tree_regressor(spark, sf_dir):
    """Ridge and a depth-3 decision tree (leaf >= 30), scored on the test period."""
    train, test, pipe = _train_test(spark, sf_dir)
    return _test_metrics(test, {"ridge": ridge(train, pipe.features, TARGET),
                                "decision_tree": decision_tree_regressor(train, pipe.features, TARGET)})


@register("forest_regressor")
def q_forest_regressor(spark, sf_dir):
    """Random forest: 500 trees, depth 12, leaf >= 2, sqrt features."""
    train, test, pipe = _train_test(spark, sf_dir)
    return _test_metrics(test, {"random_forest": random_forest_regressor(train, pipe.features, TARGET)})


@register("boosted_regressor")
def q_boosted_regressor(spark, sf_dir):
    """Both boosted presets; early stopping watches the last 20 % of each series' training period."""
    train, test, pipe = _train_test(spark, sf_dir)
    tv = time_split(train, K, T, 0.2).withColumn("is_val", F.col("split") == "test").drop("split").persist()
    try:
        return _test_metrics(test, side_by_side(spark, {
            "boosted_lgb": lambda: boosted_regressor(tv, pipe.features, TARGET, "lgb", validation_col="is_val"),
            "boosted_xgb": lambda: boosted_regressor(tv, pipe.features, TARGET, "xgb", validation_col="is_val", seed=7)}))
    finally:
        tv.unpersist()


@register("importance_table")
def q_importance_table(spark, sf_dir):
    train, _, pipe = _train_test(spark, sf_dir)
    m = decision_tree_regressor(train, pipe.features, TARGET)
    names, scores = zip(*feature_scores(m, pipe.features))
    return top_features(spark, list(names), list(scores), k=len(names))


def _class_frames(spark, sf_dir):
    train, test, pipe = _train_test(spark, sf_dir)
    train = balanced_weights(train.where(F.col(TARGET_CLASS).isNotNull()), TARGET_CLASS)
    return train, test.where(F.col(TARGET_CLASS).isNotNull()), pipe


def _classifier_metrics(test, model, name):
    pred = model.transform(test).select(F.col(TARGET_CLASS).alias("truth"),
                                        F.col("prediction").cast("int").alias("predicted"))
    return classification_metrics(pred, "truth", "predicted", [0, 1, 2, 3]).withColumn("model", F.lit(name))


@register("rf_classifier")
def q_rf_classifier(spark, sf_dir):
    """Random forest with balanced class weights (300 trees, depth 10, leaf 4)."""
    train, test, pipe = _class_frames(spark, sf_dir)
    rf = random_forest_classifier(train, pipe.features, TARGET_CLASS, weight_col="weight")
    return _classifier_metrics(test, rf, "random_forest")


@register("rf_classifier_base")
def q_rf_classifier_base(spark, sf_dir):
    """The untuned forest (300 trees, depth 12)."""
    train, test, pipe = _class_frames(spark, sf_dir)
    return _classifier_metrics(test, random_forest_classifier(train, pipe.features, TARGET_CLASS, weight_col="weight", **FOREST_PRESETS["base"]), "random_forest_base")


def _boosted_classes(spark, sf_dir, preset):
    """One softmax booster over all classes, balanced weights, at its preset's full rounds."""
    train, test, pipe = _class_frames(spark, sf_dir)
    model = boost(train, pipe.features, TARGET_CLASS, weight_col="weight", **CLASS_PRESETS[preset])
    pred = score_boosted(test, model, [TARGET_CLASS]).select(F.col(TARGET_CLASS).alias("truth"), F.col("predicted_class").alias("predicted"))
    return classification_metrics(pred, "truth", "predicted", [0, 1, 2, 3]).withColumn("model", F.lit(f"boosted_{preset}"))


@register("boosted_classifier")
def q_boosted_classifier(spark, sf_dir):
    """300 rounds, step 0.1, depth 6, leaf penalty 1."""
    return _boosted_classes(spark, sf_dir, "xgb")


@register("boosted_classifier_lgb")
def q_boosted_classifier_lgb(spark, sf_dir):
    """300 rounds, step 0.05, 31 leaves."""
    return _boosted_classes(spark, sf_dir, "lgb")


@register("boosted_classifier_tuned")
def q_boosted_classifier_tuned(spark, sf_dir):
    """300 rounds, step 0.01, 15 leaves."""
    return _boosted_classes(spark, sf_dir, "lgb_tuned")


@register("boost_round", f"""
WITH {P2I}, d AS (SELECT isodow(date) - 1 AS weekday, {sql_class('value')} AS k FROM p2i WHERE {sql_class('value')} IS NOT NULL),
pr AS (SELECT k, count(*) * 1.0 / (SELECT count(*) FROM d) AS p FROM d GROUP BY 1),
c AS (SELECT pr.k, pr.p, t.cut, d.weekday <= t.cut AS low, count(*) AS n, count(*) * pr.p - sum(CASE WHEN d.k = pr.k THEN 1 ELSE 0 END) AS g, count(*) * 2 * pr.p * (1 - pr.p) AS h
      FROM d, pr, range(0, 6) t(cut) GROUP BY 1, 2, 3, 4),
s AS (SELECT k, cut, sum(g * g / (h + 1)) AS gain FROM c GROUP BY 1, 2 HAVING min(h) >= 1),
b AS (SELECT k, arg_max(cut, struct_pack(gain := gain, first := -cut)) AS cut FROM s GROUP BY 1),
m AS (SELECT w.weekday, c.k, ln(c.p) - 0.1 * c.g / (c.h + 1) AS margin FROM b JOIN c USING (k, cut), range(0, 7) w(weekday) WHERE c.low = (w.weekday <= b.cut))
SELECT weekday, k AS class, exp(margin) / sum(exp(margin)) OVER (PARTITION BY weekday) AS probability FROM m""", doubles="probability", ints="weekday class")
def q_boost_round(spark, sf_dir):
    """One softmax round of depth 1 on the weekday: class probabilities of every weekday."""
    d = p2_filled(spark, sf_dir).select(F.weekday(T).cast("double").alias("weekday"), aqi_class("value").alias("k")).where(F.col("k").isNotNull())
    model = boost(d, ["weekday"], "k", rounds=1, max_depth=1, step=0.1, l2=1.0)
    scored = score_boosted(d.select(F.col("weekday").cast("int").alias("day"), "weekday").distinct(), model, ["day"])
    names = F.array(*[F.lit(int(k)) for k in model.labels])
    return scored.select(F.col("day").alias("weekday"), F.inline(F.arrays_zip(names.alias("class"), F.col("probabilities").alias("probability"))))


@register("boosted_penalised")
def q_boosted_penalised(spark, sf_dir):
    """Both regression boosters with leaf penalties and sampled rows and features; early stopping watches the last 20 % of each series' training period."""
    train, test, pipe = _train_test(spark, sf_dir)
    tv = time_split(train, K, T, 0.2).withColumn("is_val", F.col("split") == "test").drop("split")
    rows = None
    for name, preset in REGRESSION_PRESETS.items():
        model = boost(tv, pipe.features, TARGET, "squared", validation_col="is_val", patience=50, **preset)
        p = score_boosted(test, model, [TARGET]).select(F.col(TARGET).alias("y"), F.col("prediction").alias("yhat"), F.lit(f"boosted_{name}").alias("model"))
        rows = p if rows is None else rows.unionByName(p)
    return regression_metrics(rows, ["model"])


@register("grid_search")
def q_grid_search(spark, sf_dir):
    train, _, pipe = _class_frames(spark, sf_dir)
    cv = grid_search(train, pipe.features, TARGET_CLASS, [0, 1, 2, 3],
                     {"numTrees": [50, 100], "maxDepth": [5, 10]}, k=5, weight_col="weight")
    rows = [(str(pm), float(score), bool(score == max(cv.avgMetrics))) for pm, score in
            zip([{p.name: v for p, v in m.items()} for m in cv.getEstimatorParamMaps()], cv.avgMetrics)]
    return spark.createDataFrame(rows, "params string, macro_f1 double, best boolean")


@register("cv_evaluate")
def q_cv_evaluate(spark, sf_dir):
    train, _, pipe = _train_test(spark, sf_dir)
    folds = time_series_folds(train, K, T, k=5)
    return cv_evaluate(lambda tr: ridge(tr, pipe.features, TARGET), folds, TARGET)


@register("score_latest")
def q_score_latest(spark, sf_dir):
    """Score the newest day of every series with both models: value, band, class, confidence, agreement.

    Features come from the last 60 days of every series, not from the whole history.
    """
    train, _, pipe = _class_frames(spark, sf_dir)
    reg = ridge(train, pipe.features, TARGET)
    clf = random_forest_classifier(train, pipe.features, TARGET_CLASS, weight_col="weight")
    today = _newest(pipe.transform(last_n(region_daily_panel(spark, sf_dir), K, T, 60).drop("recency_rank")))
    r = score_regression(reg, today, K + [T])
    c = score_class(clf, today, K + [T])
    return models_agree(r.join(c, on=K + [T]), "predicted", "predicted_class")


def _newest(df):
    return df.join(df.groupBy(*K).agg(F.max(T).alias(T)), on=K + [T], how="left_semi")


def _saved_models(spark, panel, home: str, reg_features=None):
    """Fit on the panel's history (all but each series' newest day) and save; returns the marked panel, the history and the fitted regression."""
    last = panel.groupBy(*K).agg(F.max(T).alias("_last"))
    marked = materialize(panel.join(last, K), "daily_panel")
    history = marked.where(F.col(T) < F.col("_last")).drop("_last")
    pipe = FeaturePipeline(K, T, "value", MEASURES)
    train = pipe.fit_transform(history).where(F.col("split") == "train").persist()
    fitted = ridge(train, reg_features or pipe.features, TARGET)
    save_model(spark, fitted, f"{home}/reg", reg_features or pipe.features, features=pipe)
    if reg_features is None:
        classes = balanced_weights(train.where(F.col(TARGET_CLASS).isNotNull()), TARGET_CLASS)
        save_model(spark, random_forest_classifier(classes, pipe.features, TARGET_CLASS, weight_col="weight", **FOREST_PRESETS["tuned"]), f"{home}/clf", pipe.features)
    train.unpersist()
    return marked, history, fitted


def _todays_frame(spark, marked, history, home: str):
    """The newest day's feed and its feature row: hourly payload -> daily mean -> fallback -> 60-day tail -> loaded feature pipeline."""
    pipe = FeaturePipeline.load(spark, f"{home}/reg/features")
    # The feed of the newest day: its hourly readings as a payload; the second measure is missing and falls back.
    readings = marked.where(F.col(T) == F.col("_last")).select(*K, F.col(T).cast("timestamp_ntz").alias("ts"), "value")
    payload = build_hourly_payload(readings, K, "ts", ["value"])
    fed = daily_mean(explode_hourly(payload, K, ["value"]), K, "ts", ["value"], day_col=T).withColumn("n_orders", F.lit(None).cast("double"))
    today = fallback_row(fed, history, K, T, ["value", "n_orders"], {"value": 50.0, "n_orders": 1.0})
    return today, _newest(pipe.transform(append_and_tail(history, today, K, T, 60)))


def _panel(spark, sf_dir):
    return region_daily_panel(spark, sf_dir).withColumn("n_orders", F.col("n_orders").cast("double"))


@register("daily_run", f"""
WITH {REGION}, r AS (SELECT *, max(date) OVER (PARTITION BY series_id) AS last_day FROM region_p)
SELECT series_id, date AS prediction_date, CAST(date + 1 AS DATE) AS predicted_for_date, round(value, 2) AS actual_today, true AS in_range,
true AS has_advice FROM r WHERE date = last_day""", doubles="actual_today")
def q_daily_run(spark, sf_dir):
    """The daily scoring run: feed -> features -> saved models (ridge, the tuned forest of 300 trees), loaded again
    -> agreement -> upsert into the log -> JSON with advice.  Returns what does not hang on a fit; ``daily_run_ridge`` checks the predicted values."""
    home = scratch_path(spark, "daily_run")
    marked, history, _ = _saved_models(spark, _panel(spark, sf_dir), home)
    reg, names, _ = load_model(spark, f"{home}/reg")
    clf, _, _ = load_model(spark, f"{home}/clf")
    today, frame = _todays_frame(spark, marked, history, home)
    aligned = align_features(frame, names, keep=K + [T])
    scored = models_agree(score_regression(reg, aligned, K + [T]).join(score_class(clf, aligned, K + [T]), on=K + [T]), "predicted", "predicted_class")
    rows = (scored.join(today.select(*K, T, F.col("value").alias("actual_today")), on=K + [T])
            .withColumnRenamed(T, "prediction_date").withColumn("predicted_for_date", next_day("prediction_date"))
            .withColumn("aqi_category", aqi_band("predicted")))
    log = upsert_predictions(spark, rows, f"{home}/log", K + ["prediction_date"])
    made = latest_json(log, band_advice(spark), K)
    r = made.select("series_id", F.from_json("json", "prediction_date date, predicted_for_date date, actual_today double, predicted double, "
                                                     "advice struct<summary: string>").alias("r"))
    return r.select("series_id", "r.prediction_date", "r.predicted_for_date", "r.actual_today", F.col("r.predicted").between(0.0, 500.0).alias("in_range"),
                    F.col("r.advice.summary").isNotNull().alias("has_advice"))


RIDGE_ALPHA = 10.0


def _det3(m) -> str:
    (a, b, c), (d, e, f), (g, h, i) = m
    return f"(({a}) * (({e}) * ({i}) - ({f}) * ({h})) - ({b}) * (({d}) * ({i}) - ({f}) * ({g})) + ({c}) * (({d}) * ({h}) - ({e}) * ({g})))"


RUN_FEATURES = ["lag_1", "rolling_mean_7", "diff_1"]


def _daily_ridge_sql() -> str:
    """The feature panel of all but the newest days, ridge on three of its features by determinants, and the newest day's features, scaled alike."""
    fs, history = RUN_FEATURES, REGION.replace("region_p AS", "region_all AS", 1)
    panel = _feature_sql().strip()
    ctes, final = panel[:panel.rindex("SELECT series_id, date, split")], panel[panel.rindex("SELECT series_id, date, split"):]
    ctes = ctes.replace(REGION, f"{history}, newest AS (SELECT series_id, max(date) AS d FROM region_all GROUP BY 1), "
                                "region_p AS (SELECT r.* FROM region_all r JOIN newest USING (series_id) WHERE r.date < newest.d)")
    cov = [[f"s_{min(i, j)}_{max(i, j)}" + (f" + {RIDGE_ALPHA} / n" if i == j else "") for j in range(3)] for i in range(3)]
    moments = [f"avg({c}) AS m_{i}" for i, c in enumerate(fs)] + [f"avg({TARGET}) AS m_y", "count(*) AS n"]
    moments += [f"covar_pop({fs[i]}, {fs[j]}) AS s_{i}_{j}" for i in range(3) for j in range(i, 3)] + [f"covar_pop({c}, {TARGET}) AS s_{i}_y" for i, c in enumerate(fs)]
    betas = [f"{_det3([[f's_{r}_y' if col == k else cov[r][col] for col in range(3)] for r in range(3)])} / {_det3(cov)} AS b_{k}" for k in range(3)]
    scaled = [f"(t.{c} - sc.{c}__m) / CASE WHEN sc.{c}__r = 0 THEN 1.0 ELSE sc.{c}__r END" for c in fs]
    point = "m_y + " + " + ".join(f"b_{i} * ({c} - m_{i})" for i, c in enumerate(scaled))
    return f"""{ctes.rstrip()},
panel AS ({final}),
mo AS (SELECT {', '.join(moments)} FROM panel WHERE split = 'train'), co AS (SELECT mo.*, {', '.join(betas)} FROM mo),
u AS (SELECT series_id, date, value FROM region_p UNION ALL SELECT r.series_id, r.date, round(r.value, 2) FROM region_all r JOIN newest ON r.series_id = newest.series_id AND r.date = newest.d),
{grid('u', 'ug')}, {interp('ug', 'ui', ['value'])},
w AS (SELECT series_id, date, value, lag(value, 1) OVER ({W}) AS lag_1, avg(value) OVER ({W} ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS rolling_mean_7,
      value - lag(value, 1) OVER ({W}) AS diff_1 FROM ui),
t AS (SELECT w.* FROM w JOIN newest ON w.series_id = newest.series_id AND w.date = newest.d),
p AS (SELECT t.series_id, t.date AS prediction_date, t.value AS actual_today, round({clip(f'({point})', 0.0, 500.0)}, 1) AS predicted FROM t, sc, co)
SELECT *, {band_code('predicted')} AS band, true AS loaded_equals_fitted FROM p"""


@register("daily_run_ridge", _daily_ridge_sql(), doubles="actual_today predicted", ints="band")
def q_daily_run_ridge(spark, sf_dir):
    """The daily run's predicted values: a saved and loaded ridge on three features of the saved and loaded feature pipeline."""
    home = scratch_path(spark, "daily_run")
    marked, history, fitted = _saved_models(spark, _panel(spark, sf_dir), home, RUN_FEATURES)
    reg, names, _ = load_model(spark, f"{home}/reg")
    today, frame = _todays_frame(spark, marked, history, home)
    aligned = align_features(frame, names, keep=K + [T])
    scored = score_regression(reg, aligned, K + [T]).join(score_regression(fitted, aligned, K + [T]).withColumnRenamed("predicted", "_fitted"), K + [T])
    return (scored.join(today.select(*K, T, F.col("value").alias("actual_today")), K + [T])
            .select("series_id", F.col(T).alias("prediction_date"), "actual_today", "predicted", aqi_band_code("predicted").alias("band"), F.col("predicted").eqNullSafe(F.col("_fitted")).alias("loaded_equals_fitted")))


# --- deterministic-model twins with SQL oracles ------------------------------------------------------

BLEND_WEIGHTS = [0.65, 0.7, 0.75, 0.8, 0.85, 0.9]


@register("blend_sweep", f"""
WITH {BASE_SQL},
wide AS (SELECT series_id, date, y, max(yhat) FILTER (WHERE model = 'ma7') AS ma7,
         max(yhat) FILTER (WHERE model = 'naive') AS naive FROM pred GROUP BY 1, 2, 3),
x AS (SELECT y, w.weight_a, w.weight_a * ma7 + (1.0 - w.weight_a) * naive AS yhat FROM wide,
      (VALUES {', '.join(f'({w}::DOUBLE)' for w in BLEND_WEIGHTS)}) w(weight_a))
{_metrics_sql('weight_a', 'x')}""", doubles="weight_a mae mse rmse r2 mape")
def q_blend_sweep(spark, sf_dir):
    p = baseline_predictions(spark, sf_dir)
    wide = p.groupBy("series_id", T, "y").pivot("model", ["ma7", "naive"]).agg(F.first("yhat"))
    return blend_sweep(wide, "ma7", "naive", "y", BLEND_WEIGHTS)


@register("blend", f"""
WITH {BASE_SQL}
SELECT series_id, date, y, 0.65 * max(yhat) FILTER (WHERE model = 'ma7') + 0.35 * max(yhat) FILTER (WHERE model = 'naive') AS blend
FROM pred GROUP BY 1, 2, 3""", doubles="y blend")
def q_blend(spark, sf_dir):
    wide = baseline_predictions(spark, sf_dir).groupBy("series_id", T, "y").pivot("model", ["ma7", "naive"]).agg(F.first("yhat"))
    return blend(wide, ["ma7", "naive"], [0.65, 0.35]).select("series_id", T, "y", "blend")


@register("trained_leaderboard")
def q_trained_leaderboard(spark, sf_dir):
    """Trained models and the walk-forward baseline on the test days, by the day that is forecast."""
    train, test, pipe = _train_test(spark, sf_dir)
    fits = {"ridge": ridge(train, pipe.features, TARGET), "decision_tree": decision_tree_regressor(train, pipe.features, TARGET)}
    rows = None
    for name, m in fits.items():
        p = m.transform(test).select("series_id", F.date_add(T, 1).alias("target_date"), F.col(TARGET).alias("y"), F.col("prediction").alias("yhat"), F.lit(name).alias("model"))
        rows = p if rows is None else rows.unionByName(p)
    filled = interpolate(to_daily_grid(region_daily_panel(spark, sf_dir).select("series_id", T, "value"), K, T), K, T, ["value"])
    ar = ar1_walk_forward(time_split(filled, K, T), K, T, "value").select("series_id", F.col(T).alias("target_date"), "y", "yhat", F.lit("ar1").alias("model"))
    # All models are judged on the target days of the feature panel.
    asked = test.select("series_id", F.date_add(T, 1).alias("target_date"))
    rows = rows.unionByName(ar.join(asked, ["series_id", "target_date"], "left_semi"))
    return leaderboard(regression_metrics(rows, ["model"]))


@register("models_agree", f"""
WITH {BASE_SQL},
wide AS (SELECT series_id, date, max(yhat) FILTER (WHERE model = 'ma7') AS ma7,
         max(yhat) FILTER (WHERE model = 'naive') AS naive FROM pred GROUP BY 1, 2)
SELECT series_id, date, ma7, {sql_class('naive')} AS predicted_class,
{band_code('ma7')} = {sql_class('naive')} AS models_agree FROM wide""", doubles="ma7", ints="predicted_class")
def q_models_agree(spark, sf_dir):
    p = baseline_predictions(spark, sf_dir)
    wide = p.groupBy("series_id", T).pivot("model", ["ma7", "naive"]).agg(F.first("yhat"))
    x = wide.select("series_id", T, "ma7", aqi_class("naive").alias("predicted_class"))
    return models_agree(x, "ma7", "predicted_class")


CONTRIB_FEATURES = ["quantity", "discount", "tax"]


def _contrib_ctes() -> str:
    fs = CONTRIB_FEATURES
    cov = [[f"s_{min(i, j)}_{max(i, j)}" for j in range(3)] for i in range(3)]
    rhs = [f"s_{i}_y" for i in range(3)]
    moments = [f"avg({c}) AS m_{i}" for i, c in enumerate(fs)] + ["avg(price_k) AS m_y"]
    moments += [f"covar_pop({fs[i]}, {fs[j]}) AS s_{i}_{j}" for i in range(3) for j in range(i, 3)]
    moments += [f"covar_pop({fs[i]}, price_k) AS s_{i}_y" for i in range(3)]
    det = _det3(cov)
    betas = []
    for k in range(3):
        mk = [[rhs[r] if col == k else cov[r][col] for col in range(3)] for r in range(3)]
        betas.append(f"{_det3(mk)} / {det} AS b_{k}")
    pred = "b0 + " + " + ".join(f"b_{i} * {c}" for i, c in enumerate(fs))
    rows = " UNION ALL ".join(
        f"SELECT series_id, date, {pred} AS prediction, '{c}' AS feature, {c} AS value, b_{i} * ({c} - m_{i}) AS contribution, "
        f"b0 + b_0 * m_0 + b_1 * m_1 + b_2 * m_2 AS base FROM s, cf" for i, c in enumerate(fs))
    return f"""{P3_SPLIT},
sk AS (SELECT *, extendedprice / 1000.0 AS price_k FROM s),
mo AS (SELECT {', '.join(moments)} FROM sk WHERE split = 'train'),
co AS (SELECT mo.*, {', '.join(betas)} FROM mo),
cf AS (SELECT co.*, m_y - b_0 * m_0 - b_1 * m_1 - b_2 * m_2 AS b0 FROM co),
contrib AS ({rows})"""


def _contributions(spark, sf_dir):
    # Label: daily mean extended price in thousands.
    s = _p3_split(spark, sf_dir).withColumn("price_k", F.col("extendedprice") / 1000.0)
    train = s.where(F.col("split") == "train")
    intercept, coefs = fit_linear_moments(train, CONTRIB_FEATURES, "price_k")
    means = background_means(train, CONTRIB_FEATURES)
    return linear_contributions(s, ["series_id", T], CONTRIB_FEATURES, intercept, coefs, means)


@register("linear_contrib", f"WITH {_contrib_ctes()} SELECT * FROM contrib",
          doubles="prediction value contribution base")
def q_linear_contrib(spark, sf_dir):
    return _contributions(spark, sf_dir)


@register("contrib_summary", f"""
WITH {_contrib_ctes()}, g AS (SELECT feature, avg(abs(contribution)) AS mean_abs_contribution,
avg(contribution) AS mean_contribution FROM contrib GROUP BY 1)
SELECT *, row_number() OVER (ORDER BY mean_abs_contribution DESC, feature) AS rank FROM g""",
          doubles="mean_abs_contribution mean_contribution", ints="rank")
def q_contrib_summary(spark, sf_dir):
    return contribution_summary(_contributions(spark, sf_dir), top=20)


@register("explain_top", f"""
WITH {_contrib_ctes()},
best AS (SELECT series_id, date FROM contrib ORDER BY prediction DESC, series_id, date LIMIT 1),
r AS (SELECT c.series_id, c.date, c.feature, c.contribution, row_number() OVER (ORDER BY abs(c.contribution) DESC, c.feature)
      AS rank FROM contrib c JOIN best USING (series_id, date))
SELECT series_id, date, feature, contribution, rank FROM r WHERE rank <= 2
UNION ALL SELECT series_id, date, 'rest', sum(contribution), 3 FROM r WHERE rank > 2 GROUP BY 1, 2""",
          doubles="contribution", ints="rank")
def q_explain_top(spark, sf_dir):
    return explain_top(_contributions(spark, sf_dir), ["series_id", T], "prediction", k=2)


# --- learners with closed forms: the same fits, checked against SQL -------------------------------------

def _ridge_ctes() -> str:
    """Ridge on three features: the determinants of the covariances with alpha / n added on the diagonal."""
    fs = CONTRIB_FEATURES
    cov = [[f"s_{min(i, j)}_{max(i, j)}" + (f" + {RIDGE_ALPHA} / n" if i == j else "") for j in range(3)] for i in range(3)]
    rhs = [f"s_{i}_y" for i in range(3)]
    moments = [f"avg({c}) AS m_{i}" for i, c in enumerate(fs)] + ["avg(price_k) AS m_y", "count(*) AS n"]
    moments += [f"covar_pop({fs[i]}, {fs[j]}) AS s_{i}_{j}" for i in range(3) for j in range(i, 3)]
    moments += [f"covar_pop({fs[i]}, price_k) AS s_{i}_y" for i in range(3)]
    det = _det3(cov)
    betas = [f"{_det3([[rhs[r] if col == k else cov[r][col] for col in range(3)] for r in range(3)])} / {det} AS b_{k}" for k in range(3)]
    return f"""{P3_SPLIT},
sk AS (SELECT *, extendedprice / 1000.0 AS price_k FROM s),
mo AS (SELECT {', '.join(moments)} FROM sk WHERE split = 'train'),
co AS (SELECT mo.*, {', '.join(betas)} FROM mo),
cf AS (SELECT co.*, m_y - b_0 * m_0 - b_1 * m_1 - b_2 * m_2 AS b0 FROM co)"""


def _price_split(spark, sf_dir):
    return _p3_split(spark, sf_dir).withColumn("price_k", F.col("extendedprice") / 1000.0)


def _price_ridge(spark, sf_dir):
    s = _price_split(spark, sf_dir)
    return s, ridge(s.where(F.col("split") == "train"), CONTRIB_FEATURES, "price_k", alpha=RIDGE_ALPHA)


@register("ridge_price", f"""
WITH {_ridge_ctes()} SELECT series_id, date, split, least(greatest(b0 + {' + '.join(f'b_{i} * {c}' for i, c in enumerate(CONTRIB_FEATURES))}, 0.0), 500.0) AS predicted
FROM s, cf""", doubles="predicted")
def q_ridge_price(spark, sf_dir):
    """Ridge fitted by Spark ML on three measures; every day's prediction."""
    s, model = _price_ridge(spark, sf_dir)
    return score_regression(model, s, K + [T, "split"], digits=None)


@register("top_features_price", f"""
WITH {_ridge_ctes()}, l AS ({' UNION ALL '.join(f"SELECT '{c}' AS feature, b_{i} AS score FROM cf" for i, c in enumerate(CONTRIB_FEATURES))})
SELECT *, row_number() OVER (ORDER BY abs(score) DESC, feature) AS rank FROM l""", doubles="score", ints="rank")
def q_top_features_price(spark, sf_dir):
    _, model = _price_ridge(spark, sf_dir)
    names, scores = zip(*feature_scores(model, CONTRIB_FEATURES))
    return top_features(spark, list(names), list(scores), k=20)


def _ridge_rows_sql() -> str:
    return " UNION ALL ".join(
        f"SELECT series_id, date, b0 + b_0 * {CONTRIB_FEATURES[0]} + b_1 * {CONTRIB_FEATURES[1]} + b_2 * {CONTRIB_FEATURES[2]} AS prediction, '{c}' AS feature, "
        f"{c} AS value, b_{i} * ({c} - m_{i}) AS contribution, b0 + b_0 * m_0 + b_1 * m_1 + b_2 * m_2 AS base FROM s, cf" for i, c in enumerate(CONTRIB_FEATURES))


@register("ridge_contrib", f"WITH {_ridge_ctes()}, x AS ({_ridge_rows_sql()}) SELECT * FROM x", doubles="prediction value contribution base")
def q_ridge_contrib(spark, sf_dir):
    """Exact contributions of the trained ridge model."""
    s, model = _price_ridge(spark, sf_dir)
    last = model.stages[-1]
    means = background_means(s.where(F.col("split") == "train"), CONTRIB_FEATURES)
    return linear_contributions(s, ["series_id", T], CONTRIB_FEATURES, float(last.intercept), [float(c) for c in last.coefficients], means)


_FOLD_SQL = f"""{P3},
b AS (SELECT *, row_number() OVER ({W}) - 1 AS rn, count(*) OVER (PARTITION BY series_id) AS n FROM p3),
fo AS (SELECT b.*, t.fold, n - 5 * (n // 6) + t.fold * (n // 6) AS start_, n // 6 AS size_ FROM b, range(0, 5) t(fold)),
ro AS (SELECT * FROM (SELECT *, CASE WHEN rn < start_ THEN 'train' WHEN rn < start_ + size_ THEN 'test' END AS role FROM fo) WHERE role IS NOT NULL)"""


@register("cv_one_feature", f"""
WITH {_FOLD_SQL},
c AS (SELECT fold, regr_slope(extendedprice, quantity) AS k, regr_intercept(extendedprice, quantity) AS a FROM ro WHERE role = 'train' GROUP BY 1),
p AS (SELECT ro.fold, extendedprice / 1000.0 AS y, (c.a + c.k * quantity) / 1000.0 AS yhat FROM ro JOIN c USING (fold) WHERE role = 'test')
SELECT fold, count(*) AS n, avg(abs(y - yhat)) AS mae, avg((y - yhat) * (y - yhat)) AS mse, sqrt(avg((y - yhat) * (y - yhat))) AS rmse,
1 - sum((y - yhat) * (y - yhat)) / (var_pop(y) * count(*)) AS r2, avg(abs((y - yhat) / (y + 1e-9))) * 100 AS mape,
min(yhat) AS pred_min, max(yhat) AS pred_max FROM p GROUP BY 1""", doubles="mae mse rmse r2 mape pred_min pred_max", ints="fold")
def q_cv_one_feature(spark, sf_dir):
    """Expanding folds, least squares on one feature in each."""
    panel = p3_measure_panel(spark, sf_dir).withColumn("price_k", F.col("extendedprice") / 1000.0)
    folds = time_series_folds(panel, K, T, k=5)
    return cv_evaluate(lambda tr: ridge(tr, ["quantity"], "price_k", alpha=0.0), folds, "price_k")


@register("stump_learners", f"""
WITH {P2I}, d AS (SELECT isodow(date) - 1 AS weekday, value FROM p2i),
g AS (SELECT weekday, count(*) AS n, sum(value) AS s FROM d GROUP BY 1),
c AS (SELECT t.c, sum(n) FILTER (WHERE weekday <= t.c) AS nl, sum(s) FILTER (WHERE weekday <= t.c) AS sl, sum(n) FILTER (WHERE weekday > t.c) AS nr,
      sum(s) FILTER (WHERE weekday > t.c) AS sr FROM g, range(0, 6) t(c) GROUP BY 1),
best AS (SELECT * FROM c ORDER BY sl * sl / nl + sr * sr / nr DESC, c LIMIT 1)
SELECT m.model, g.weekday, CASE WHEN g.weekday <= best.c THEN sl / nl ELSE sr / nr END AS prediction
FROM g, best, (VALUES ('tree'), ('forest'), ('boosted')) m(model)""", doubles="prediction", ints="weekday")
def q_stump_learners(spark, sf_dir):
    """One split on the weekday, as a tree, as a forest of one tree on all rows and as one round of boosting."""
    d = p2_filled(spark, sf_dir).select((F.weekday(T)).cast("double").alias("weekday"), "value").persist()
    one = ["weekday"]
    fits = {
        "tree": decision_tree_regressor(d, one, "value", max_depth=1, min_leaf=1),
        "forest": random_forest_regressor(d, one, "value", trees=1, max_depth=1, min_leaf=1, features_per_split="all", bootstrap=False),
        "boosted": boosted_regressor(d, one, "value", "xgb", maxIter=1, maxDepth=1, subsamplingRate=1.0, featureSubsetStrategy="all"),
    }
    days = d.select("weekday").distinct()
    out = None
    for name, m in fits.items():
        p = m.transform(days).select(F.lit(name).alias("model"), F.col("weekday").cast("int").alias("weekday"), "prediction")
        out = p if out is None else out.unionByName(p)
    return out


# --- tree-path explanations ------------------------------------------------------------------------------

def _two_level_ctes() -> str:
    """A tree of depth 2 on weekday and month by sums over cells: the best root split, the best split of each side, the four leaves."""
    left = "CASE c.f WHEN 0 THEN g.weekday <= c.cut ELSE g.month <= c.cut END"
    sums = f"sum(n) FILTER ({left}) AS nl, sum(s) FILTER ({left}) AS sl, sum(n) FILTER (NOT ({left})) AS nr, sum(s) FILTER (NOT ({left})) AS sr"
    gain = "sl * sl / nl + sr * sr / nr"
    return f"""{P2I}, d AS (SELECT CAST(isodow(date) - 1 AS DOUBLE) AS weekday, CAST(month(date) AS DOUBLE) AS month, value FROM p2i),
g AS (SELECT weekday, month, count(*) AS n, sum(value) AS s FROM d GROUP BY 1, 2),
c AS (SELECT 0 AS f, range AS cut FROM range(0, 6) UNION ALL SELECT 1, range FROM range(1, 12)),
r AS (SELECT * FROM (SELECT c.f, c.cut, {sums} FROM g, c GROUP BY 1, 2) ORDER BY {gain} DESC, f, cut LIMIT 1),
gs AS (SELECT g.*, CASE r.f WHEN 0 THEN g.weekday <= r.cut ELSE g.month <= r.cut END AS lower FROM g, r),
h AS (SELECT * FROM (SELECT g.lower, c.f, c.cut, {sums} FROM gs g, c GROUP BY 1, 2, 3) WHERE nl > 0 AND nr > 0
      QUALIFY row_number() OVER (PARTITION BY lower ORDER BY {gain} DESC, f, cut) = 1),
l AS (SELECT * FROM h WHERE lower), u AS (SELECT * FROM h WHERE NOT lower)"""


def _two_level_sql() -> str:
    """Shapley values of two players from the four expectations: known features follow the row, unknown ones the counts."""
    def side(t: str, known: tuple) -> str:
        row = f"CASE WHEN CASE {t}.f WHEN 0 THEN g.weekday ELSE g.month END <= {t}.cut THEN {t}.sl / {t}.nl ELSE {t}.sr / {t}.nr END"
        return f"CASE WHEN {t}.f IN ({', '.join(map(str, known))}) THEN {row} ELSE ({t}.sl + {t}.sr) / ({t}.nl + {t}.nr) END" if known else f"({t}.sl + {t}.sr) / ({t}.nl + {t}.nr)"

    def expectation(known: tuple) -> str:
        mean = f"(r.nl * {side('l', known)} + r.nr * {side('u', known)}) / (r.nl + r.nr)"
        return f"CASE WHEN r.f IN ({', '.join(map(str, known))}) THEN CASE WHEN g.lower THEN {side('l', known)} ELSE {side('u', known)} END ELSE {mean} END" if known else mean

    return f"""v AS (SELECT g.weekday, g.month, {expectation(())} AS v0, {expectation((0,))} AS v1, {expectation((1,))} AS v2, {expectation((0, 1))} AS v12 FROM gs g, r, l, u),
contrib AS (SELECT weekday, month, v12 AS prediction, 'weekday' AS feature, weekday AS value, (v1 - v0 + v12 - v2) / 2 AS contribution, v0 AS base FROM v
UNION ALL SELECT weekday, month, v12, 'month', month, (v2 - v0 + v12 - v1) / 2, v0 FROM v)"""


def _calendar_tree(spark, sf_dir, depth):
    d = p2_filled(spark, sf_dir).select(F.weekday(T).cast("double").alias("weekday"), F.month(T).cast("double").alias("month"), "value")
    model = decision_tree_regressor(d, ["weekday", "month"], "value", max_depth=depth, min_leaf=1)
    cells = d.select("weekday", "month").distinct().select(F.col("weekday").alias("w"), F.col("month").alias("m"), "weekday", "month")
    found = tree_contributions(cells, ["w", "m"], read_trees(spark, model, ["weekday", "month"]))
    return found.withColumnsRenamed({"w": "weekday", "m": "month"})


@register("tree_contrib_1", f"""
WITH {P2I}, d AS (SELECT CAST(isodow(date) - 1 AS DOUBLE) AS weekday, CAST(month(date) AS DOUBLE) AS month, value FROM p2i),
g AS (SELECT weekday, month, count(*) AS n, sum(value) AS s FROM d GROUP BY 1, 2),
c AS (SELECT 0 AS f, range AS cut FROM range(0, 6) UNION ALL SELECT 1, range FROM range(1, 12)),
m AS (SELECT c.f, c.cut, CASE c.f WHEN 0 THEN g.weekday <= c.cut ELSE g.month <= c.cut END AS lower, sum(n) AS n, sum(s) AS s FROM g, c GROUP BY 1, 2, 3),
b AS (SELECT f, cut FROM m GROUP BY 1, 2 ORDER BY sum(s * s / n) DESC, f, cut LIMIT 1),
p AS (SELECT g.weekday, g.month, b.f, m.s / m.n AS prediction FROM g, b JOIN m USING (f, cut) WHERE m.lower = CASE b.f WHEN 0 THEN g.weekday <= b.cut ELSE g.month <= b.cut END),
o AS (SELECT avg(value) AS base FROM d)
SELECT weekday, month, prediction, 'weekday' AS feature, weekday AS value, CASE WHEN f = 0 THEN prediction - base ELSE 0.0 END AS contribution, base FROM p, o
UNION ALL SELECT weekday, month, prediction, 'month', month, CASE WHEN f = 1 THEN prediction - base ELSE 0.0 END, base FROM p, o""",
          doubles="weekday month prediction value contribution base")
def q_tree_contrib_1(spark, sf_dir):
    """One split: the feature that splits takes the whole difference to the mean."""
    return _calendar_tree(spark, sf_dir, 1)


@register("tree_contrib_2", f"WITH {_two_level_ctes()}, {_two_level_sql()} SELECT * FROM contrib", doubles="weekday month prediction value contribution base")
def q_tree_contrib_2(spark, sf_dir):
    """Two levels on two features: exact Shapley values of every cell, and the tree's predictions."""
    return _calendar_tree(spark, sf_dir, 2)


@register("tree_explain_top", f"""
WITH {_two_level_ctes()}, {_two_level_sql()},
best AS (SELECT weekday, month FROM contrib ORDER BY prediction DESC, weekday DESC, month DESC LIMIT 1),
x AS (SELECT c.weekday, c.month, c.feature, c.contribution, row_number() OVER (ORDER BY abs(c.contribution) DESC, c.feature) AS rank FROM contrib c JOIN best USING (weekday, month))
SELECT weekday, month, CASE WHEN rank = 1 THEN feature ELSE 'rest' END AS feature, contribution, rank FROM x""", doubles="weekday month contribution", ints="rank")
def q_tree_explain_top(spark, sf_dir):
    """The largest contribution of the row with the highest prediction; of equal predictions the greatest cell."""
    found = _calendar_tree(spark, sf_dir, 2)
    # ``max_by`` takes any row of equal predictions: the cell breaks the tie.
    place = F.struct("prediction", "weekday", "month").alias("place")
    return explain_top(found.select("*", place), ["weekday", "month"], "place", k=1)


@register("tree_importance", f"""
WITH {_two_level_ctes()},
x AS (SELECT f, nl, sl, nr, sr FROM r UNION ALL SELECT f, nl, sl, nr, sr FROM h),
gains AS (SELECT f, sum(sl * sl / nl + sr * sr / nr - (sl + sr) * (sl + sr) / (nl + nr)) AS gain FROM x GROUP BY 1),
names AS (SELECT * FROM (VALUES (0, 'weekday'), (1, 'month')) v(f, feature)),
i AS (SELECT feature, coalesce(gain, 0) / sum(gain) OVER () AS score FROM names LEFT JOIN gains USING (f))
SELECT feature, score, row_number() OVER (ORDER BY score DESC, feature) AS rank FROM i""", doubles="score", ints="rank")
def q_tree_importance(spark, sf_dir):
    """Importances of the tree of two levels: what its splits take off the squared error, as shares."""
    d = p2_filled(spark, sf_dir).select(F.weekday(T).cast("double").alias("weekday"), F.month(T).cast("double").alias("month"), "value")
    model = decision_tree_regressor(d, ["weekday", "month"], "value", max_depth=2, min_leaf=1)
    names, scores = zip(*feature_scores(model, ["weekday", "month"]))
    return top_features(spark, list(names), list(scores), k=2)


@register("forest_contrib")
def q_forest_contrib(spark, sf_dir):
    """Mean absolute contributions of a forest (100 trees of depth 6) on the test days of the feature panel."""
    train, test, pipe = _train_test(spark, sf_dir)
    model = random_forest_regressor(train, pipe.features, TARGET, trees=100, max_depth=6, min_leaf=4)
    return contribution_summary(tree_contributions(test, ["series_id", T], read_trees(spark, model, pipe.features)), top=20)


@register("forest_explain_top")
def q_forest_explain_top(spark, sf_dir):
    """The twelve largest contributions, and the rest, of the test day that the forest predicts highest."""
    train, test, pipe = _train_test(spark, sf_dir)
    model = random_forest_regressor(train, pipe.features, TARGET, trees=100, max_depth=6, min_leaf=4)
    trees = read_trees(spark, model, pipe.features)
    # Only the chosen row is explained.
    top = model.transform(test).agg(F.max_by(F.struct("series_id", T), F.struct("prediction", "series_id", T)).alias("b")).select("b.*")
    return explain_top(tree_contributions(test.join(top, ["series_id", T], "left_semi"), ["series_id", T], trees), ["series_id", T], "prediction", k=12)


@register("fold_counts", f"""
WITH {P2I}, c AS (SELECT series_id, date, {sql_class('value')} AS label FROM p2i WHERE {sql_class('value')} IS NOT NULL),
n AS (SELECT label, count(*) AS n FROM c GROUP BY 1)
SELECT label, f.fold, n // 5 + CASE WHEN (f.fold + 4) % 5 < n % 5 THEN 1 ELSE 0 END AS rows FROM n, range(0, 5) f(fold)
WHERE n // 5 + CASE WHEN (f.fold + 4) % 5 < n % 5 THEN 1 ELSE 0 END > 0""", ints="label fold rows")
def q_fold_counts(spark, sf_dir):
    """Rows of each class in each stratified fold."""
    c = p2_filled(spark, sf_dir).select("series_id", T, aqi_class("value").alias("label")).where(F.col("label").isNotNull())
    return stratified_folds(c, "label", 5).groupBy("label", "fold").agg(F.count(F.lit(1)).alias("rows"))


# --- per-series autoregressive baselines ----------------------------------------------------------------

AR_CTES = f"""{P2I},
s AS (SELECT series_id, date, value, lag(value, 1) OVER ({W}) AS y1, CASE WHEN row_number() OVER ({W}) >
      count(*) OVER (PARTITION BY series_id) - ceil(count(*) OVER (PARTITION BY series_id) * 0.2) THEN 'test'
      ELSE 'train' END AS split FROM p2i),
c AS (SELECT series_id, regr_intercept(value, y1) AS intercept, regr_slope(value, y1) AS phi,
      sqrt((regr_syy(value, y1) - regr_slope(value, y1) * regr_sxy(value, y1)) / (regr_count(value, y1) - 2)) AS sigma
      FROM s WHERE split = 'train' GROUP BY 1),
f AS (SELECT s.series_id, s.date, s.value AS y, {clip('(c.intercept + c.phi * s.y1)', 0.0, 500.0)} AS yhat,
      c.intercept + c.phi * s.y1 - 1.96 * c.sigma AS lower, c.intercept + c.phi * s.y1 + 1.96 * c.sigma AS upper
      FROM s JOIN c USING (series_id) WHERE s.split = 'test')"""


def _ar1(spark, sf_dir):
    return ar1_walk_forward(time_split(p2_filled(spark, sf_dir), K, T), K, T, "value")


@register("ar1_forecast", f"WITH {AR_CTES} SELECT * FROM f", doubles="y yhat lower upper")
def q_ar1_forecast(spark, sf_dir):
    return _ar1(spark, sf_dir)


@register("ar1_metrics", f"WITH {AR_CTES}, pred AS (SELECT 'ar1' AS model, y, yhat FROM f) {_metrics_sql('model')}",
          doubles="mae mse rmse r2 mape")
def q_ar1_metrics(spark, sf_dir):
    return regression_metrics(_ar1(spark, sf_dir).withColumn("model", F.lit("ar1")), ["model"])


def _ar3_sql() -> str:
    lags = ["y1", "y2", "y3"]
    cov = [[f"s_{min(i, j)}_{max(i, j)}" for j in range(3)] for i in range(3)]
    rhs = [f"s_{i}_y" for i in range(3)]
    moments = [f"avg({c}) AS m_{i}" for i, c in enumerate(lags)] + ["avg(value) AS m_y"]
    moments += [f"covar_pop({lags[i]}, {lags[j]}) AS s_{i}_{j}" for i in range(3) for j in range(i, 3)]
    moments += [f"covar_pop({lags[i]}, value) AS s_{i}_y" for i in range(3)]
    det = _det3(cov)
    betas = [f"{_det3([[rhs[r] if col == k else cov[r][col] for col in range(3)] for r in range(3)])} / {det} AS b_{k}"
             for k in range(3)]
    point = "(c.b0 + c.b_0 * s.y1 + c.b_1 * s.y2 + c.b_2 * s.y3)"
    return f"""
WITH {P2I},
s AS (SELECT series_id, date, value, lag(value, 1) OVER ({W}) AS y1, lag(value, 2) OVER ({W}) AS y2,
      lag(value, 3) OVER ({W}) AS y3, CASE WHEN row_number() OVER ({W}) > count(*) OVER (PARTITION BY series_id)
      - ceil(count(*) OVER (PARTITION BY series_id) * 0.2) THEN 'test' ELSE 'train' END AS split FROM p2i),
mo AS (SELECT series_id, {', '.join(moments)} FROM s WHERE split = 'train' AND y3 IS NOT NULL GROUP BY 1),
co AS (SELECT mo.*, {', '.join(betas)} FROM mo),
c AS (SELECT co.*, m_y - b_0 * m_0 - b_1 * m_1 - b_2 * m_2 AS b0 FROM co)
SELECT s.series_id, s.date, s.value AS y, {clip(point, 0.0, 500.0)} AS yhat FROM s JOIN c USING (series_id)
WHERE s.split = 'test'"""


@register("ar3_forecast", _ar3_sql(), doubles="y yhat")
def q_ar3_forecast(spark, sf_dir):
    return ar_p_walk_forward(time_split(p2_filled(spark, sf_dir), K, T), K, T, "value", p=3)


@register("ar1_multistep", f"""
WITH {P2I},
l AS (SELECT series_id, date, value, lag(value, 1) OVER ({W}) AS y1 FROM p2i),
c AS (SELECT series_id, regr_intercept(value, y1) AS a, regr_slope(value, y1) AS phi FROM l GROUP BY 1),
last AS (SELECT series_id, arg_max(value, date) AS x, max(date) AS t FROM p2i GROUP BY 1)
SELECT series_id, h.h, CAST(t + CAST(h.h AS INTEGER) AS DATE) AS date,
  a / (1.0 - phi) + pow(phi, h.h) * (x - a / (1.0 - phi)) AS forecast
FROM last JOIN c USING (series_id), range(1, 31) h(h)""", doubles="forecast", ints="h")
def q_ar1_multistep(spark, sf_dir):
    return ar1_multistep(p2_filled(spark, sf_dir), K, T, "value", horizon=30)


@register("dickey_fuller", f"""
WITH {P2I},
l AS (SELECT series_id, value - lag(value, 1) OVER ({W}) AS dy, lag(value, 1) OVER ({W}) AS y1 FROM p2i),
g AS (SELECT series_id, regr_slope(dy, y1) AS rho, regr_sxx(dy, y1) AS sxx, regr_syy(dy, y1) AS syy,
      regr_sxy(dy, y1) AS sxy, regr_count(dy, y1) AS n FROM l GROUP BY 1)
SELECT series_id, rho, n, rho / sqrt(((syy - rho * sxy) / (n - 2)) / sxx) AS t_stat,
rho / sqrt(((syy - rho * sxy) / (n - 2)) / sxx) < -2.86 AS stationary FROM g""", doubles="rho t_stat")
def q_dickey_fuller(spark, sf_dir):
    return dickey_fuller(p2_filled(spark, sf_dir), K, T, "value")
