"""Connected components of a link table, by alternating large and small stars.

Every round is two grouped minima joined back to the links, written to the shared
checkpoint folder once; nothing but one checksum row reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from panelstack.session import materialize


def _kept(links: DataFrame) -> tuple[DataFrame, tuple]:
    """The links written and read back, and their number and hash sum, observed while they are written."""
    seen = Observation()
    links = links.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 31))).alias("h"))
    kept = materialize(links, "cc-links")
    return kept, (seen.get["n"], seen.get["h"])


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) of every linked node; ``links`` has long columns a, b; root is the component's least node.

    Self-links and repeats are allowed; no links give no rows.  A round is one plan and one written table.
    """
    now, seen = _kept(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    for _ in range(max_rounds):
        # Large star: every node hands its greater neighbours to the least node it knows.
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("u")).agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.filter("b > a").join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: every node and its lesser neighbours go to the least of them.
        least = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        moved = large.join(least, F.col("a") == F.col("u")).select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
        before = seen
        now, seen = _kept(moved.filter("a <> b").distinct())
        if seen == before:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct())
