"""Sinks: panel/report files, the idempotent prediction log and the latest-JSON record."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from panelstack.functions.bands import BAND_LABELS
from panelstack.session import drop_path, materialize
from panelstack.sources.readers import read_dimension


def write_panel(df: DataFrame, path: str, partition_by: list[str] | None = None,
                fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Processed panel (and its split column) as a partitioned table.

    Partition by a low-cardinality column (``split``, ``year``), never by the
    series key: thousands of series would mean thousands of tiny directories.
    """
    w = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        w = w.option("header", True)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)


def write_report(df: DataFrame, path: str) -> None:
    """Leaderboard/report table as header CSV (one file; reports are a few rows)."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def upsert_rows(log: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``log`` whose key is not in ``new``, plus all of ``new``; columns that one side lacks are null there."""
    return log.join(new.select(*keys).distinct(), on=keys, how="left_anti").unionByName(new, allowMissingColumns=True)


def one_per_key(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key: of several the greatest in the order of the other columns."""
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    return df.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("_r")).select(*keys, "_r.*").select(*df.columns)


def upsert_predictions(spark: SparkSession, new: DataFrame, path: str, keys: list[str],
                       partition_col: str = "prediction_date", spread: int = 8) -> DataFrame:
    """Idempotent upsert of ``new`` into the log at ``path``; one row per key.

    Only the partitions that ``new`` touches are read and rewritten (dynamic
    partition overwrite).  ``new`` is materialised once (it is read three times), and
    so are the merged rows, in the shared checkpoint folder: that cuts the lineage back
    to the files about to be replaced and survives executor loss.  Replaying a batch
    yields the same log.  A log that is not there yet is the only error taken for an
    empty one; columns that only one side has are null for the other.  Rows of a
    partition are spread over ``spread`` tasks.
    """
    rows = materialize(one_per_key(new, keys), "upsert_new")
    try:
        existing = spark.read.option("mergeSchema", True).parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        merged, scratch = rows, []
    else:
        # The folder name gives the partition value: back to the type of the new rows.
        existing = existing.withColumn(partition_col, F.col(partition_col).cast(dict(rows.dtypes)[partition_col]))
        old = existing.join(rows.select(partition_col).distinct(), on=partition_col, how="left_semi")
        merged = materialize(upsert_rows(old, rows, keys), "upsert_merged")
        scratch = list(merged.inputFiles()[:1])
    (merged.repartition(F.col(partition_col), F.pmod(F.xxhash64(*keys), F.lit(spread))).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy(partition_col).parquet(path))
    for file in [*rows.inputFiles()[:1], *scratch]:
        drop_path(spark, file.rpartition("/")[0])
    return spark.read.option("mergeSchema", True).parquet(path)


#: Columns of the advice dimension: one row per band label.
ADVICE_SCHEMA = "label string, emoji string, summary string, actions array<string>"


def read_advice(spark: SparkSession, path: str) -> DataFrame:
    """The advice dimension (JSON lines: label, emoji, summary, actions); texts belong to the operator of the log."""
    return read_dimension(spark, path, fmt="json", schema=ADVICE_SCHEMA)


def lookup_advice(df: DataFrame, advice: DataFrame, label_col: str, default: str = "Moderate") -> DataFrame:
    """Left join of the advice table (AQE broadcasts it at its measured size); unknown labels use ``default``."""
    lab = F.when(F.col(label_col).isin(BAND_LABELS), F.col(label_col)).otherwise(F.lit(default))
    a = advice.withColumnRenamed("label", "_advice_label")
    return (df.withColumn("_lookup", lab)
            .join(a, F.col("_lookup") == F.col("_advice_label"), "left")
            .drop("_lookup", "_advice_label"))


def latest_json(log: DataFrame, advice: DataFrame, keys: list[str], t: str = "prediction_date",
                label_col: str = "aqi_category") -> DataFrame:
    """Newest log row per series plus its advice, serialised as one JSON string per series."""
    newest = log.groupBy(*keys).agg(F.max_by(F.struct(*log.columns), F.col(t)).alias("_r")).select("_r.*")
    enriched = lookup_advice(newest, advice, label_col)
    payload = F.to_json(F.struct(*[F.col(c) for c in log.columns],
                                 F.struct("emoji", "summary", "actions").alias("advice")))
    return enriched.select(*keys, payload.alias("json"))
