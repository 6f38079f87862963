"""Top-k reports: feature rankings, leaderboards and the largest contributions of one prediction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def top_features(spark: SparkSession, names: list[str], scores: list[float], k: int = 20) -> DataFrame:
    """Rank model coefficients/importances by absolute value (one row per feature: bounded)."""
    df = spark.createDataFrame([(n, float(s)) for n, s in zip(names, scores)], "feature string, score double")
    w = Window.orderBy(F.abs(F.col("score")).desc(), F.col("feature"))
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


# Metric direction (True = larger is better).
METRIC_HIGHER_IS_BETTER = {"r2": True, "mae": False, "rmse": False, "mse": False, "mape": False}


def leaderboard(metrics: DataFrame, model_col: str = "model", sort_by: str = "rmse") -> DataFrame:
    """Models ordered by ``sort_by`` plus, for every metric, whether the model is the best on it."""
    out = metrics
    for m, higher in METRIC_HIGHER_IS_BETTER.items():
        if m in metrics.columns:
            order = F.col(m).desc() if higher else F.col(m).asc()
            out = out.withColumn(f"best_{m}", F.row_number().over(Window.orderBy(order, F.col(model_col))) == 1)
    return out.withColumn("position", F.row_number().over(Window.orderBy(F.col(sort_by), F.col(model_col))))


def explain_top(contrib_long: DataFrame, id_cols: list[str], pred_col: str, k: int = 12) -> DataFrame:
    """For the row with the largest prediction: its ``k`` largest |contribution| features plus a 'rest' row.

    ``contrib_long`` has one row per (row id, feature).  The chosen row is found
    by an aggregate (``max_by``), then only its features are ranked.
    """
    best = contrib_long.agg(F.max_by(F.struct(*id_cols), F.col(pred_col)).alias("_b")).select("_b.*")
    rows = contrib_long.join(best, on=id_cols, how="left_semi")
    w = Window.partitionBy(*id_cols).orderBy(F.abs(F.col("contribution")).desc(), F.col("feature"))
    ranked = rows.withColumn("rank", F.row_number().over(w))
    top = ranked.where(F.col("rank") <= k).select(*id_cols, "feature", "contribution", "rank")
    rest = (ranked.where(F.col("rank") > k).groupBy(*id_cols)
            .agg(F.sum("contribution").alias("contribution"))
            .select(*id_cols, F.lit("rest").alias("feature"), "contribution", F.lit(k + 1).alias("rank")))
    return top.unionByName(rest)
