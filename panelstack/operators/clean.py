"""Projections, filters and null handling (schema driven, all JVM-side expressions)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelstack.functions.bands import nan_to_null
from panelstack.operators.quantiles import order_statistics


def drop_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.drop(*[c for c in cols if c in df.columns])


def numeric_columns(df: DataFrame, exclude: list[str] | None = None) -> list[str]:
    """Names of numeric columns in schema order, minus ``exclude``."""
    exclude = set(exclude or [])
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in exclude]


def between_dates(df: DataFrame, t: str, start, end) -> DataFrame:
    """Inclusive on both ends; a plain range predicate so parquet can skip row groups."""
    return df.where(F.col(t).between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def threshold_counts(df: DataFrame, keys: list[str], col: str,
                     thresholds: dict[str, Column] | None = None) -> DataFrame:
    """Count and share of rows satisfying each predicate, per series (one aggregate pass)."""
    v = F.col(col)
    thresholds = thresholds or {"above_100": v > 100, "at_most_50": v <= 50, "above_12": v > 12, "above_35_4": v > 35.4}
    aggs = [F.count(v).alias("n")]
    for name, pred in thresholds.items():
        aggs.append(F.count_if(pred).alias(f"n_{name}"))
        aggs.append((F.avg(F.when(v.isNotNull(), F.when(pred, 1.0).otherwise(0.0))) * 100).alias(f"pct_{name}"))
    return df.groupBy(*keys).agg(*aggs)


def null_audit(df: DataFrame, keys: list[str] | None = None, cols: list[str] | None = None) -> DataFrame:
    """Per column: dtype, null count, null % (3 dp); plus rows with any null.  One aggregate, then unpivot."""
    keys = keys or []
    cols = cols or [c for c in df.columns if c not in keys]
    types = dict(df.dtypes)
    aggs = [F.count(F.lit(1)).alias("_rows"),
            F.count_if(F.greatest(*[F.col(c).isNull().cast("int") for c in cols]) == 1).alias("rows_with_null")]
    aggs += [F.count_if(F.col(c).isNull()).alias(f"_n_{c}") for c in cols]
    wide = df.groupBy(*keys).agg(*aggs)
    stacked = wide.select(*keys, "_rows", "rows_with_null", F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.lit(types[c]).alias("dtype"), F.col(f"_n_{c}").alias("null_count"))
        for c in cols])))
    return stacked.withColumn("null_pct", F.round(F.col("null_count") * 100.0 / F.col("_rows"), 3)).drop("_rows")


def drop_incomplete(df: DataFrame, subset: list[str] | None = None) -> DataFrame:
    """Drop rows with any null (NaN counts as null) in ``subset`` (default: all columns)."""
    subset = subset or df.columns
    doubles = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    cond = F.lit(True)
    for c in subset:
        cond = cond & F.col(c).isNotNull()
        if c in doubles:
            cond = cond & ~F.isnan(F.col(c))
    return df.where(cond)


def align_features(df: DataFrame, feature_cols: list[str], keep: list[str] | None = None) -> DataFrame:
    """Keep the training features that exist, in training order (plus ``keep`` columns)."""
    keep = [c for c in (keep or []) if c in df.columns]
    return df.select(*keep, *[c for c in feature_cols if c in df.columns])


def fit_medians(train: DataFrame, cols: list[str], keys: list[str] | None = None) -> DataFrame:
    """Exact interpolated medians of ``cols`` on training rows: per key, or over all rows (one row)."""
    if keys:
        return train.groupBy(*keys).agg(*[F.percentile(nan_to_null(c), 0.5).alias(c) for c in cols])
    found = order_statistics(train, cols, [0.5])
    return train.sparkSession.createDataFrame([[found.quantile(c, 0.5) for c in cols]], ", ".join(f"`{c}` double" for c in cols))


def fill_values(df: DataFrame, values: dict[str, float | None]) -> DataFrame:
    """coalesce(x, value) for every named column; NaN counts as missing."""
    return df.withColumns({c: F.coalesce(nan_to_null(c), F.lit(v).cast("double")) for c, v in values.items()})


def fill_median(df: DataFrame, medians: DataFrame, cols: list[str], keys: list[str] | None = None) -> DataFrame:
    """coalesce(x, train median).

    Per-series medians are joined on the keys (AQE broadcasts the table only
    when its measured size allows); global medians are a single row and are
    inlined as literals, leaving a pure projection.
    """
    keys = keys or []
    if not keys:
        row = medians.first()
        return fill_values(df, {c: row[c] for c in cols})
    m = medians.select(*keys, *[F.col(c).alias(f"_med_{c}") for c in cols])
    j = df.join(m, on=keys, how="left")
    return j.withColumns({c: F.coalesce(nan_to_null(c), F.col(f"_med_{c}")) for c in cols}).drop(
        *[f"_med_{c}" for c in cols])


def fallback_row(today: DataFrame, history: DataFrame, keys: list[str], t: str, measures: list[str],
                 defaults: dict[str, float]) -> DataFrame:
    """Missing feed values -> last known non-null value of the series -> constant default.

    The as-of "last value" is an aggregate (``max_by`` of each measure by time over
    non-null rows), partial-combined map side, so a long history never lands in one task.
    """
    last = history.groupBy(*keys).agg(*[
        F.max_by(F.col(m), F.when(F.col(m).isNotNull(), F.col(t))).alias(f"_last_{m}") for m in measures])
    j = today.join(last, on=keys, how="left")
    return j.withColumns({
        m: F.coalesce(nan_to_null(m), F.col(f"_last_{m}"), F.lit(float(defaults.get(m, 0.0)))) for m in measures
    }).drop(*[f"_last_{m}" for m in measures])


def relabel(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed({k: v for k, v in mapping.items() if k in df.columns})
