"""Exact additive explanations of linear models and least squares from aggregated moments."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def fit_linear_moments(train: DataFrame, features: list[str], label: str, alpha: float = 0.0):
    """OLS / ridge (unpenalised intercept) from one aggregate of centred moments.

    Spark computes means, covariances and label covariances in a single pass
    (map-side combined); the (p x p) system is solved on the driver, its size
    bounded by the number of features.  Returns (intercept, coefficients).
    """
    cols = features + [label]
    complete = F.lit(True)
    for c in cols:
        complete = complete & F.col(c).isNotNull()
    x = train.where(complete)
    aggs = [F.avg(c).alias(f"mean_{c}") for c in cols] + [F.count(F.lit(1)).alias("n")]
    aggs += [F.covar_pop(a, b).alias(f"cov_{i}_{j}") for i, a in enumerate(cols) for j, b in enumerate(cols) if j >= i]
    r = x.agg(*aggs).first()
    p = len(features)
    cov = np.zeros((p + 1, p + 1))
    for i in range(p + 1):
        for j in range(i, p + 1):
            cov[i, j] = cov[j, i] = r[f"cov_{i}_{j}"]
    n = r["n"]
    sxx = cov[:p, :p] * n + alpha * np.eye(p)
    sxy = cov[:p, p] * n
    beta = np.linalg.solve(sxx, sxy)
    intercept = r[f"mean_{label}"] - float(np.dot(beta, [r[f"mean_{c}"] for c in features]))
    return float(intercept), [float(b) for b in beta]


def background_means(df: DataFrame, features: list[str]) -> dict[str, float]:
    r = df.agg(*[F.avg(c).alias(c) for c in features]).first()
    return {c: float(r[c]) for c in features}


def linear_contributions(df: DataFrame, id_cols: list[str], features: list[str], intercept: float,
                         coefs: list[float], means: dict[str, float]) -> DataFrame:
    """Long (ids, feature, value, contribution, base, prediction) with contribution = coef*(x - mean_bg).

    For a linear model with independent features these are the exact Shapley
    values; base + sum(contributions) = prediction (tested).
    """
    base = intercept + sum(b * means[c] for c, b in zip(features, coefs))
    pred = F.lit(float(intercept))
    for c, b in zip(features, coefs):
        pred = pred + F.lit(float(b)) * F.col(c)
    rows = F.inline(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value"),
                 (F.lit(float(b)) * (F.col(c) - F.lit(float(means[c])))).alias("contribution"))
        for c, b in zip(features, coefs)]))
    return df.select(*id_cols, pred.alias("prediction"), rows).withColumn("base", F.lit(float(base)))


def contribution_summary(contrib: DataFrame, top: int = 20) -> DataFrame:
    """Mean |contribution| per feature, ranked (one row per feature: bounded)."""
    g = contrib.groupBy("feature").agg(F.avg(F.abs("contribution")).alias("mean_abs_contribution"),
                                       F.avg("contribution").alias("mean_contribution"))
    w = Window.orderBy(F.col("mean_abs_contribution").desc(), F.col("feature"))
    return g.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
