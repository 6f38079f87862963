"""Readers: observation tables, dimensions, hourly payloads, prediction logs."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelstack.session import materialize


def read_observations(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
                      fmt: str = "parquet", date_col: str = "date") -> DataFrame:
    """Daily observation table; CSV with header or parquet, explicit schema, parsed date."""
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        df = reader.option("header", True).csv(path)
    else:
        df = reader.format(fmt).load(path)
    if date_col in df.columns:
        df = df.withColumn(date_col, F.to_date(F.col(date_col)))
    return df


def read_checked(spark: SparkSession, path: str, schema: str, header: bool = True, sep: str = ",") -> tuple[DataFrame, DataFrame]:
    """A CSV folder as (rows, rejects): rows that follow the schema, and the lines that do not, with a reason.

    A line is rejected where it has too many or too few fields (``fields``) or a field that is no value of its column's type
    (``value``); ``columns`` names those.  An empty field is a null, not an error.  Every line comes out once, in one of the two; the
    input is parsed once and written to the shared folder.
    """
    wanted = T.StructType.fromDDL(schema)
    line = "_line"
    while line in wanted.names:
        line += "_"
    raw = (spark.read.schema(wanted.add(line, T.StringType())).option("header", header).option("sep", sep).option("mode", "PERMISSIVE")
           .option("columnNameOfCorruptRecord", line).csv(path))
    kept = materialize(raw, "observations")
    names = [f.name for f in wanted.fields if f.name != line]
    parts = F.split(F.col(line), re.escape(sep), -1)
    lost = F.filter(F.array(*[F.when(F.col(f"`{c}`").isNull() & (F.length(F.trim(F.try_element_at(parts, F.lit(i + 1)))) > 0), F.lit(c)) for i, c in enumerate(names)]), lambda x: x.isNotNull())
    whole = F.size(parts) == len(names)
    rejects = kept.where(F.col(line).isNotNull()).select(F.col(line).alias("line"), F.when(whole, "value").otherwise("fields").alias("reason"),
                                                         F.when(whole, F.array_join(lost, ",")).otherwise(F.lit("")).alias("columns"))
    return kept.where(F.col(line).isNull()).drop(line), rejects


def read_dimension(spark: SparkSession, path: str, fmt: str = "csv",
                   schema: T.StructType | str | None = None) -> DataFrame:
    """Small dimension (city / stations).  Callers broadcast it only after checking its size."""
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        return reader.option("header", True).csv(path)
    return reader.format(fmt).load(path)


def annotate_schema(df: DataFrame, dictionary: dict[str, dict[str, str]]) -> DataFrame:
    """Attach unit/description metadata to columns (dictionary: column -> {unit, description})."""
    for name, meta in dictionary.items():
        if name in df.columns:
            df = df.withMetadata(name, {k: v for k, v in meta.items() if v is not None})
    return df


def build_hourly_payload(hourly: DataFrame, keys: list[str], ts: str, measures: list[str]) -> DataFrame:
    """Group hourly rows into one payload per (series, day): struct of parallel arrays.

    The group is one series-day, i.e. at most 24 elements per array for hourly
    data, so the per-group collect is bounded by the grain, not by the data size.
    """
    day = F.to_date(F.col(ts)).alias("day")
    entries = F.array_sort(F.collect_list(F.struct(F.col(ts).alias("t"), *[F.col(m) for m in measures])))
    g = hourly.groupBy(*keys, day).agg(entries.alias("_e"))
    fields = [F.transform("_e", lambda x: F.date_format(x["t"], "yyyy-MM-dd'T'HH:mm")).alias("time")]
    fields += [F.transform("_e", _field_getter(m)).alias(m) for m in measures]
    return g.select(*keys, F.struct(*fields).alias("hourly"))


def _field_getter(name: str):
    def get(x):
        return x[name]
    return get


def explode_hourly(payload: DataFrame, keys: list[str], measures: list[str],
                   payload_col: str = "hourly") -> DataFrame:
    """Parallel arrays -> rows (keys, ts, measures); null elements are kept."""
    h = F.col(payload_col)
    zipped = F.arrays_zip(h["time"].alias("time"), *[h[m].alias(m) for m in measures])
    rows = payload.select(*keys, F.inline(zipped))
    return rows.select(*keys, F.to_timestamp_ntz(F.col("time"), F.lit("yyyy-MM-dd'T'HH:mm")).alias("ts"),
                       *measures)


def read_predictions(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Prediction log with lenient date parsing (unparsable -> null) sorted by date."""
    df = spark.read.format(fmt).option("header", True).load(path) if fmt == "csv" else spark.read.format(fmt).load(path)
    return lenient_dates(df, ["prediction_date", "predicted_for_date"]).orderBy("prediction_date")


def lenient_dates(df: DataFrame, cols: list[str]) -> DataFrame:
    """String columns -> DATE, anything unparsable becomes null instead of failing."""
    out = {}
    for c in cols:
        if c in df.columns:
            s = F.col(c).cast("string")
            out[c] = F.coalesce(F.try_to_timestamp(s, F.lit("yyyy-MM-dd")),
                                F.try_to_timestamp(s, F.lit("yyyy-MM-dd HH:mm:ss")),
                                F.try_to_timestamp(s, F.lit("dd/MM/yyyy"))).cast("date")
    return df.withColumns(out)
