"""Exact quantiles of whole columns, by one distributed pass for every size.

Values are counted by (column, value) with a hash aggregate (map-side combined,
so a hot value is one row a task), the counts are written out in range
partitions, and only per-partition totals reach the driver (partitions x columns
rows).  From their prefix sums the two ranks around p (n - 1) are located; the
partitions that hold them are read again and give the order statistics, which
are interpolated linearly (the definition of ``percentile``, NumPy and pandas).
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelstack.functions.bands import nan_to_null
from panelstack.session import materialize


@dataclass
class OrderStatistics:
    """For each column its number of values and, by probability, (weight of the upper, lower, upper order statistic)."""

    n: dict[str, int]
    around: dict[tuple[str, float], tuple[float, float, float]]

    def quantile(self, col: str, p: float, transform: Callable[[float], float] = float) -> float | None:
        """The interpolated quantile, null for a column without values.

        A non-decreasing ``transform`` is applied to the order statistics, which
        gives the quantile of the transformed column.
        """
        if not self.n.get(col):
            return None
        share, low, high = self.around[(col, p)]
        low, high = transform(low), transform(high)
        return low if share == 0 else (1 - share) * low + share * high


def order_statistics(df: DataFrame, cols: list[str], probs: list[float]) -> OrderStatistics:
    """Order statistics around the given probabilities of every column; null and NaN do not count."""
    spark = df.sparkSession
    long = (df.select(*[nan_to_null(c).cast("double").alias(c) for c in cols])
            .select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("value")) for c in cols])))
            .where(F.col("value").isNotNull()))
    counts = materialize(long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n")), "value_counts")
    ranged = materialize(counts.repartitionByRange("column", "value").withColumn("part", F.spark_partition_id()), "value_ranges")
    totals = ranged.groupBy("column", "part").agg(F.sum("n").alias("n")).orderBy("column", "part").collect()

    n = dict.fromkeys(cols, 0)
    for r in totals:
        n[r["column"]] += r["n"]
    wanted, around = [], {}
    for c in cols:
        if not n[c]:
            continue
        parts = [(r["part"], r["n"]) for r in totals if r["column"] == c]
        for p in probs:
            place = p * (n[c] - 1)
            for side, rank in (("low", math.floor(place)), ("high", math.ceil(place))):
                before = 0
                for part, size in parts:
                    if rank < before + size:
                        wanted.append((c, part, p, side, rank - before))
                        break
                    before += size
            around[(c, p)] = place - math.floor(place)
    if not wanted:
        return OrderStatistics(n, {})
    # Two rows for each column and probability.
    asked = F.broadcast(spark.createDataFrame(wanted, "column string, part int, p double, side string, rank long"))
    w = Window.partitionBy("column", "part").orderBy("value")
    hit = ranged.join(asked.select("column", "part").distinct(), ["column", "part"], "left_semi")
    hit = hit.withColumn("upto", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    found = (hit.join(asked, ["column", "part"]).where((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("n")))
             .select("column", "p", "side", "value").collect())
    value = {(r["column"], r["p"], r["side"]): r["value"] for r in found}
    return OrderStatistics(n, {(c, p): (share, value[(c, p, "low")], value[(c, p, "high")]) for (c, p), share in around.items()})
