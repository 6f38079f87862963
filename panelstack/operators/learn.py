"""Learners and scoring on the feature panel, built on Spark ML.

Estimators receive a DataFrame with feature columns; a ``VectorAssembler`` is
the first pipeline stage, so the same fitted ``PipelineModel`` scores training,
test and streaming rows.  Fits run distributed (tree learners aggregate
histograms per partition; the normal-equation solver aggregates X'X once).
"""

from __future__ import annotations

import itertools
from collections.abc import Callable
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, OneVsRest, RandomForestClassifier
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelstack.functions.bands import aqi_band_code, clip
from panelstack.operators.metrics import classification_metrics, regression_metrics


#: Histogram buffer of the tree learners (``maxMemoryInMB``), fixed: nodes are grouped by it, and the order in
#: which feature subsets are drawn follows the groups, so a value taken from the heap would change the models.
TREE_BUFFER_MB = 32


def _pipeline(features: list[str], estimator) -> Pipeline:
    """Missing features are an error here: training drops or fills them, scoring fills them with training medians."""
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features", handleInvalid="error"), estimator])


def ridge(train: DataFrame, features: list[str], label: str, alpha: float = 10.0) -> PipelineModel:
    """Ridge with an unpenalised intercept, same optimum as ||y - Xb||^2 + alpha ||b||^2.

    Spark scales the squared loss by 1/(2n) and the penalty by regParam/2 on
    coefficients expressed in units of std(y), hence regParam = alpha * std_pop(y) / n.
    """
    s = train.agg(F.stddev_pop(label).alias("sd"), F.count(F.col(label)).alias("n")).first()
    reg = alpha * float(s["sd"]) / int(s["n"])
    lr = LinearRegression(featuresCol="features", labelCol=label, solver="normal", elasticNetParam=0.0,
                          standardization=False, regParam=reg, fitIntercept=True)
    return _pipeline(features, lr).fit(train)


def decision_tree_regressor(train, features, label, max_depth: int = 3, min_leaf: int = 30, seed: int = 42):
    return _pipeline(features, DecisionTreeRegressor(labelCol=label, maxDepth=max_depth, minInstancesPerNode=min_leaf,
                                                     seed=seed, maxMemoryInMB=TREE_BUFFER_MB)).fit(train)


def random_forest_regressor(train, features, label, trees: int = 500, max_depth: int = 12, min_leaf: int = 2,
                            seed: int = 42, features_per_split: str = "sqrt", bootstrap: bool = True):
    rf = RandomForestRegressor(labelCol=label, numTrees=trees, maxDepth=max_depth, minInstancesPerNode=min_leaf, bootstrap=bootstrap,
                               featureSubsetStrategy=features_per_split, seed=seed, maxMemoryInMB=TREE_BUFFER_MB)
    return _pipeline(features, rf).fit(train)


# The two boosted-tree presets (trees, learning rate, depth, row share, feature share, least rows of a leaf).
# Leaf-wise growth to 31 leaves has no counterpart here: a tree of depth 5 has at most 32.
BOOST_PRESETS = {
    "lgb": {"maxIter": 500, "stepSize": 0.05, "maxDepth": 5, "subsamplingRate": 0.8, "featureSubsetStrategy": "0.8", "minInstancesPerNode": 20},
    "xgb": {"maxIter": 500, "stepSize": 0.05, "maxDepth": 6, "subsamplingRate": 0.8, "featureSubsetStrategy": "0.8", "minInstancesPerNode": 20},
}

# Classifier settings of the forests, base and tuned (those of the boosters stand in :mod:`panelstack.operators.boost`).
FOREST_PRESETS = {"base": {"trees": 300, "max_depth": 12, "min_leaf": 1}, "tuned": {"trees": 300, "max_depth": 10, "min_leaf": 4}}

# Search axes.  Where depth has no limit or a split needs so many rows, Spark has no such setting: the
# deepest tree is 30 levels, and a least leaf of half the rows stands for a least split.
FOREST_GRID = {"numTrees": [200, 300, 500], "maxDepth": [10, 15, 20, 30], "minInstancesPerNode": [1, 2, 4, 5]}
BOOST_GRID = {"maxIter": [200, 300], "stepSize": [0.01, 0.05], "maxDepth": [4, 5, 6, 8, 10], "minInstancesPerNode": [2, 5, 10]}


def best_prefix(losses: list[float], patience: int) -> int:
    """Number of trees at the least loss before ``patience`` rounds without improvement."""
    best = 0
    for i, x in enumerate(losses):
        if x < losses[best]:
            best = i
        elif i - best >= patience:
            break
    return best + 1


def boosted_regressor(train, features, label, preset: str = "lgb", validation_col: str | None = None,
                      patience: int = 50, seed: int = 42, **overrides):
    """Gradient-boosted trees; with ``validation_col`` the trees up to the best validation round are kept.

    The loss of every round is measured on the rows marked for validation, and the model
    is fitted again with its best number of rounds once ``patience`` rounds brought no gain.  The first run has a
    fifth more rounds than ``patience``, the next twice ``patience``, and they double until that is seen (a longer run with
    the same seed begins with the same trees, so the result is that of fitting all rounds).  Use the tail of the *training*
    period as validation, never the test set.  A frame that the caller has persisted is read as it is, so that
    several boosters can share it, side by side too.
    """
    params = dict(BOOST_PRESETS[preset], **overrides)
    if not validation_col:
        return _pipeline(features, GBTRegressor(labelCol=label, seed=seed, maxMemoryInMB=TREE_BUFFER_MB, **params)).fit(train)
    rounds, most = patience + max(1, patience // 5), params.pop("maxIter")
    taught, held = train.where(~F.col(validation_col)), train.where(F.col(validation_col))
    own = [] if train.is_cached else [taught.persist(), held.persist()]

    def fit(trees: int) -> PipelineModel:
        return _pipeline(features, GBTRegressor(labelCol=label, seed=seed, maxMemoryInMB=TREE_BUFFER_MB, maxIter=trees, **params)).fit(taught)

    try:
        while True:
            model = fit(min(rounds, most))
            losses = list(model.stages[-1].evaluateEachIteration(model.stages[0].transform(held), "squared"))
            keep = best_prefix(losses, patience)
            if rounds >= most or len(losses) - keep >= patience:
                return model if keep == len(losses) else fit(keep)
            rounds = 2 * patience if rounds < 2 * patience else 2 * rounds
    finally:
        for df in own:
            df.unpersist()


def side_by_side(spark: SparkSession, fits: dict[str, Callable]) -> dict:
    """The models of independent fits by name, fitted at the same time (a round of small jobs waits on their scheduling)."""
    with ThreadPool(max(1, len(fits))) as pool:
        made = pool.map(lambda task: task(), [inheritable_thread_target(spark)(f) for f in fits.values()])
    return dict(zip(fits, made, strict=True))


def random_forest_classifier(train, features, label, weight_col: str | None = None, trees: int = 300,
                             max_depth: int = 10, min_leaf: int = 4, seed: int = 42):
    rf = RandomForestClassifier(labelCol=label, numTrees=trees, maxDepth=max_depth, minInstancesPerNode=min_leaf,
                                seed=seed, maxMemoryInMB=TREE_BUFFER_MB)
    if weight_col:
        rf = rf.setWeightCol(weight_col)
    return _pipeline(features, rf).fit(train)


def boosted_classifier(train, features, label, weight_col: str | None = None, trees: int = 300,
                       step: float = 0.05, max_depth: int = 6, seed: int = 42, parallelism: int = 4, min_leaf: int = 1):
    """Multi-class boosting as one-vs-rest over binary GBTs (no native multi-class GBT in Spark).

    The per-class binary models are independent, so ``parallelism`` of them are fitted
    concurrently.
    """
    gbt = GBTClassifier(maxIter=trees, stepSize=step, maxDepth=max_depth, seed=seed, minInstancesPerNode=min_leaf,
                        maxMemoryInMB=TREE_BUFFER_MB)
    ovr = OneVsRest(classifier=gbt, labelCol=label, parallelism=parallelism)
    if weight_col:
        ovr = ovr.setWeightCol(weight_col)
    return _pipeline(features, ovr).fit(train)


def blend(df: DataFrame, cols: list[str], weights: list[float], name: str = "blend") -> DataFrame:
    expr = None
    for c, w in zip(cols, weights):
        term = F.col(c) * F.lit(float(w))
        expr = term if expr is None else expr + term
    return df.withColumn(name, expr)


def blend_sweep(df: DataFrame, a: str, b: str, y: str, weights: list[float]) -> DataFrame:
    """Metrics of w*a + (1-w)*b for each w: rows are replicated once per weight (a fixed, small list)."""
    x = df.withColumn("weight_a", F.explode(F.array(*[F.lit(float(w)) for w in weights])))
    x = x.withColumn("yhat", F.col("weight_a") * F.col(a) + (F.lit(1.0) - F.col("weight_a")) * F.col(b))
    return regression_metrics(x.withColumnRenamed(y, "y"), ["weight_a"])


def score_regression(model: PipelineModel, df: DataFrame, keep: list[str], lo: float = 0.0, hi: float = 500.0,
                     digits: int | None = 1) -> DataFrame:
    """One row per input row; missing features are an error (fill them first)."""
    value = clip("prediction", lo, hi)
    return model.transform(df).select(*keep, (value if digits is None else F.round(value, digits)).alias("predicted"))


def score_class(model: PipelineModel, df: DataFrame, keep: list[str], digits: int = 1) -> DataFrame:
    """Predicted class + confidence = probability of that class * 100."""
    p = model.transform(df)
    prob = vector_to_array(F.col("probability"))
    conf = F.element_at(prob, F.col("prediction").cast("int") + 1) * 100
    return p.select(*keep, F.col("prediction").cast("int").alias("predicted_class"),
                    F.round(conf, digits).alias("class_confidence"))


def models_agree(df: DataFrame, reg_col: str, class_col: str) -> DataFrame:
    """True when the band of the regression forecast equals the predicted class."""
    return df.withColumn("models_agree", aqi_band_code(reg_col) == F.col(class_col))


def feature_scores(model: PipelineModel, features: list[str]) -> list[tuple[str, float]]:
    """Coefficients (linear) or importances (trees) per feature name: one value per feature."""
    last = model.stages[-1]
    if hasattr(last, "coefficients"):
        vals = last.coefficients.toArray()
    else:
        vals = last.featureImportances.toArray()
    return list(zip(features, [float(v) for v in vals]))


def cv_evaluate(estimator_factory: Callable[[DataFrame], PipelineModel], folds: DataFrame, label: str,
                fold_col: str = "fold", role_col: str = "role", k: int = 5) -> DataFrame:
    """Fit on each fold's train rows, score its test rows; one metrics row per fold.

    The loop runs over the k folds only; every fit is a distributed job, and one aggregate
    over all folds' predictions gives the metrics and the predictions' range.
    """
    preds = None
    for i in range(k):
        fold = folds.where(F.col(fold_col) == i)
        model = estimator_factory(fold.where(F.col(role_col) == "train"))
        p = model.transform(fold.where(F.col(role_col) == "test")).select(F.lit(i).alias(fold_col), F.col(label).alias("y"), F.col("prediction").alias("yhat"))
        preds = p if preds is None else preds.unionByName(p)
    return regression_metrics(preds, [fold_col], clip=None, extremes=("pred_min", "pred_max"))


class MacroF1Evaluator(Evaluator):
    """Macro-averaged F1 over a fixed label list (absent classes count as 0)."""

    def __init__(self, labels: list[int], label_col: str = "label", prediction_col: str = "prediction"):
        super().__init__()
        self.labels, self.label_col, self.prediction_col = labels, label_col, prediction_col

    def _evaluate(self, dataset: DataFrame) -> float:
        m = classification_metrics(dataset, self.label_col, self.prediction_col, self.labels)
        return float(m.select("macro_f1").first()[0])

    def isLargerBetter(self) -> bool:
        return True


def stratified_folds(df: DataFrame, label: str, k: int = 5, seed: int = 42, fold_col: str = "fold",
                     id_cols: list[str] | None = None, buckets: int = 256) -> DataFrame:
    """Fold = (position within class, in a seeded random order) mod k: every class spread over all folds.

    Rows are numbered inside (class, hash bucket) and shifted by the rows of the class
    in earlier buckets (a classes x buckets table), so a class that holds most rows is
    dealt over many tasks.  The order hashes ``id_cols`` (default: every column that is
    not a float), so it does not hang on the last bit of a feature.
    """
    ids = id_cols or [c for c, t in df.dtypes if t not in ("double", "float")]
    h, b = fresh_name(df, "_h"), fresh_name(df, "_b")
    x = df.withColumn(h, F.xxhash64(F.lit(seed), *[F.col(c) for c in ids])).withColumn(b, F.pmod(F.col(h), F.lit(buckets)))
    counts = x.groupBy(label, b).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(label).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col(label).alias("_l"), F.col(b).alias("_ob"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(label, b).orderBy(h, *ids))
    x = x.withColumn("_rn", inside).join(offsets, F.col(label).eqNullSafe(F.col("_l")) & (F.col(b) == F.col("_ob")))
    return x.withColumn(fold_col, ((F.col("_rn") + F.col("_before")) % k).cast("int")).select(*df.columns, fold_col)


def fresh_name(df: DataFrame, name: str) -> str:
    while name in df.columns:
        name += "_"
    return name


def grid_search(train: DataFrame, features: list[str], label: str, labels: list[int], grid: dict[str, list],
                k: int = 5, weight_col: str | None = None, parallelism: int = 4, estimator: str = "forest",
                id_cols: list[str] | None = None):
    """Cross-validated search of a classifier ("forest" or one-vs-rest "boosted") on stratified folds, scored by macro F1.

    ``grid`` maps parameter names to values (``FOREST_GRID`` and ``BOOST_GRID`` are the full axes).  Returns the
    fitted ``CrossValidatorModel``: ``bestModel`` is refitted on all rows, ``avgMetrics`` has a score for each setting.
    """
    folds = stratified_folds(train, label, k, id_cols=id_cols)
    counts = {r[0] for r in folds.groupBy("fold").agg(F.count(F.lit(1))).collect()}
    if len(counts) < k:
        raise ValueError(f"{k} folds need a class of at least {k} rows")
    if estimator == "forest":
        model = RandomForestClassifier(labelCol=label, seed=42, maxMemoryInMB=TREE_BUFFER_MB)
        maps = ParamGridBuilder()
        for name, values in grid.items():
            maps = maps.addGrid(model.getParam(name), values)
        settings = maps.build()
    else:
        model = OneVsRest(classifier=GBTClassifier(seed=42, maxMemoryInMB=TREE_BUFFER_MB), labelCol=label, parallelism=parallelism)
        combos = [dict(zip(grid, values)) for values in itertools.product(*grid.values())]
        settings = ParamGridBuilder().addGrid(model.classifier, [GBTClassifier(seed=42, maxMemoryInMB=TREE_BUFFER_MB, **c) for c in combos]).build()
    if weight_col:
        model = model.setWeightCol(weight_col)
    cv = CrossValidator(estimator=_pipeline(features, model), estimatorParamMaps=settings, numFolds=k, foldCol="fold",
                        evaluator=MacroF1Evaluator(labels, label), parallelism=parallelism, seed=42)
    return cv.fit(folds)
