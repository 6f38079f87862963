"""Model-quality metrics computed as grouped aggregates over long prediction tables.

A prediction table has one row per (model, series, date) with truth ``y`` and
prediction ``yhat``; every metric is a single ``groupBy(by).agg`` (map-side
combined), so the table size never reaches one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelstack.functions.bands import clip as clip_col
from panelstack.operators.stats import histogram


def regression_metrics(df: DataFrame, by: list[str], y: str = "y", yhat: str = "yhat",
                       clip: tuple[float, float] | None = (0.0, 500.0), clip_truth: bool = False,
                       extremes: tuple[str, str] | None = None) -> DataFrame:
    """MAE, MSE, RMSE, R2 = 1 - SSE/SST and MAPE = mean(|e/(y+1e-9)|)*100; predictions clipped first.

    ``extremes`` names two more columns for the least and greatest prediction.
    """
    p = clip_col(yhat, *clip) if clip else F.col(yhat)
    t = clip_col(y, *clip) if (clip and clip_truth) else F.col(y)
    base = df.select(*by, t.alias("_y"), p.alias("_p")).where(F.col("_y").isNotNull() & F.col("_p").isNotNull())
    e = F.col("_y") - F.col("_p")
    g = base.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"),
        F.sum(e * e).alias("_sse"), (F.var_pop("_y") * F.count(F.lit(1))).alias("_sst"),
        (F.avg(F.abs(e / (F.col("_y") + F.lit(1e-9)))) * 100).alias("mape"),
        *([F.min("_p").alias(extremes[0]), F.max("_p").alias(extremes[1])] if extremes else []))
    return (g.withColumn("rmse", F.sqrt("mse"))
            .withColumn("r2", F.lit(1.0) - F.try_divide(F.col("_sse"), F.col("_sst")))
            .drop("_sse", "_sst"))


def error_by_month(df: DataFrame, by: list[str], t: str, y: str = "y", yhat: str = "yhat") -> DataFrame:
    """MAE per (model, month) and the worst month per model (ties -> lowest month)."""
    m = F.month(F.to_date(F.col(t)))
    g = df.groupBy(*by, m.alias("month")).agg(F.avg(F.abs(F.col(y) - F.col(yhat))).alias("mae"),
                                             F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*by)
    worst = F.max_by(F.col("month"), F.struct(F.col("mae"), -F.col("month"))).over(w)
    return g.withColumn("worst_month", worst)


def residuals(df: DataFrame, y: str = "y", yhat: str = "yhat") -> DataFrame:
    return df.withColumn("residual", F.col(y) - F.col(yhat))


def residual_summary(df: DataFrame, by: list[str], y: str = "y", yhat: str = "yhat") -> DataFrame:
    """Mean (bias), sample std and extremes of y - yhat per model."""
    r = F.col(y) - F.col(yhat)
    return df.groupBy(*by).agg(F.avg(r).alias("mean_residual"), F.stddev_samp(r).alias("std_residual"),
                               F.min(r).alias("min_residual"), F.max(r).alias("max_residual"))


def residual_histogram(df: DataFrame, by: list[str], y: str = "y", yhat: str = "yhat", bins: int = 40) -> DataFrame:
    return histogram(residuals(df, y, yhat), by, "residual", bins)


def cv_summary(fold_metrics: DataFrame, by: list[str]) -> DataFrame:
    """Mean/std of R2 and mean MAE/RMSE over folds, 4 dp."""
    return fold_metrics.groupBy(*by).agg(
        F.round(F.avg("r2"), 4).alias("r2_mean"), F.round(F.stddev_samp("r2"), 4).alias("r2_std"),
        F.round(F.avg("mae"), 4).alias("mae_mean"), F.round(F.avg("rmse"), 4).alias("rmse_mean"),
        F.count(F.lit(1)).alias("folds"))


def balanced_weights(df: DataFrame, label: str, weight_col: str = "weight") -> DataFrame:
    """w = n / (k * n_class), k = number of classes present.

    Class counts are a grouped aggregate (one row per class) that is joined back;
    AQE broadcasts it at its measured size.
    """
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("_nc"))
    totals = counts.select(F.sum("_nc").over(Window.partitionBy()).alias("_n"),
                           F.count(F.lit(1)).over(Window.partitionBy()).alias("_k"), label, "_nc")
    w = totals.select(label, (F.col("_n") / (F.col("_k") * F.col("_nc"))).alias(weight_col))
    return df.join(w, on=label, how="left")


def confusion_matrix(df: DataFrame, truth: str, pred: str, labels: list[int], by: list[str] | None = None) -> DataFrame:
    """Counts for every (truth, predicted) label pair, zero-filled, overall or for every group of ``by``.

    One aggregate with a counter per pair (labels squared, a fixed small number), then an unpivot.
    """
    by = by or []
    cells = [(i, j) for i in labels for j in labels]
    g = df.groupBy(*by).agg(*[F.count_if((F.col(truth) == i) & (F.col(pred) == j)).alias(f"_c{i}_{j}") for i, j in cells])
    return g.select(*by, F.inline(F.array(*[
        F.struct(F.lit(i).alias("truth"), F.lit(j).alias("predicted"), F.col(f"_c{i}_{j}").alias("n")) for i, j in cells])))


def classification_metrics(df: DataFrame, truth: str, pred: str, labels: list[int]) -> DataFrame:
    """Per-class precision/recall/F1/support plus accuracy, macro and weighted F1 (zero_division=0).

    Macro averages run over the fixed ``labels`` even when a class has no rows.
    """
    x = df.where(F.col(truth).isNotNull() & F.col(pred).isNotNull())
    aggs = [F.count(F.lit(1)).alias("_n"), F.count_if(F.col(truth) == F.col(pred)).alias("_hit")]
    for j in labels:
        aggs += [F.count_if((F.col(truth) == j) & (F.col(pred) == j)).alias(f"_tp{j}"),
                 F.count_if(F.col(pred) == j).alias(f"_pp{j}"),
                 F.count_if(F.col(truth) == j).alias(f"_sup{j}")]
    g = x.agg(*aggs)

    def z(num, den):
        return F.coalesce(F.try_divide(num, den), F.lit(0.0))

    per = []
    for j in labels:
        p = z(F.col(f"_tp{j}").cast("double"), F.col(f"_pp{j}"))
        r = z(F.col(f"_tp{j}").cast("double"), F.col(f"_sup{j}"))
        f1 = z(2 * p * r, p + r)
        per.append(F.struct(F.lit(str(j)).alias("label"), p.alias("precision"), r.alias("recall"),
                            f1.alias("f1"), F.col(f"_sup{j}").alias("support")))
    rows = g.select("_n", "_hit", F.inline(F.array(*per)))
    w = Window.partitionBy()
    summary = rows.select(
        "label", "precision", "recall", "f1", "support",
        (F.col("_hit") / F.col("_n")).alias("accuracy"),
        F.avg("precision").over(w).alias("macro_precision"), F.avg("recall").over(w).alias("macro_recall"),
        F.avg("f1").over(w).alias("macro_f1"),
        (F.sum(F.col("f1") * F.col("support")).over(w) / F.col("_n")).alias("weighted_f1"))
    return summary


def fit_gap(metrics: DataFrame, by: list[str], split_col: str = "split") -> DataFrame:
    """R2(train) - R2(test) per model from a metrics table that has a split column."""
    g = metrics.groupBy(*by).agg(F.max(F.when(F.col(split_col) == "train", F.col("r2"))).alias("r2_train"),
                                 F.max(F.when(F.col(split_col) == "test", F.col("r2"))).alias("r2_test"))
    return g.withColumn("gap", F.col("r2_train") - F.col("r2_test"))


def coverage(df: DataFrame, keys: list[str], t: str, split_col: str = "split", features: list[str] | None = None) -> DataFrame:
    """Date range and rows per series and split; with ``features`` also how many of them the table has."""
    counts = [] if features is None else [F.lit(sum(c in df.columns for c in features)).alias("n_features")]
    return df.groupBy(*keys).agg(F.min(t).alias("first_date"), F.max(t).alias("last_date"),
                                 F.count(F.lit(1)).alias("rows"),
                                 F.count_if(F.col(split_col) == "train").alias("train_rows"),
                                 F.count_if(F.col(split_col) == "test").alias("test_rows"), *counts)
