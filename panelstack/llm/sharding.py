"""Contiguous shards of equal bytes.

Rows get a global order (id, then position in the input).  Every range partition
sums its sizes; the totals' prefix sums (one number per partition, on the driver)
turn running sums inside the partitions into global byte positions, and those
are cut at equal targets.  The texts are read once and never shuffled.

Defined cases: a null text has 0 bytes (size 1); null ids come first; repeated
ids and wholly equal rows keep their input order; an empty table gives no rows;
other columns of the input are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelstack.session import materialize


def byte_positions(rows: DataFrame, order: list[str], size: str, name: str = "positions") -> tuple[DataFrame, int, int]:
    """``rows`` in global order with ``row_at`` and ``byte_at`` (what lies before a row); total rows and bytes.

    ``rows`` should be narrow and cheap to read twice (range bounds are sampled).
    The driver sees one row per partition; ``order`` must be unique.
    """
    spark = rows.sparkSession
    def running(batches):
        part, row, byte = TaskContext.get().partitionId(), 0, 0
        for b in batches:
            sizes = b.column(size).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum(sizes) + byte
            cols = [*b.columns, pa.array(np.full(len(sizes), part, np.int32)), pa.array(np.arange(len(sizes)) + row), pa.array(ends - sizes)]
            yield pa.RecordBatch.from_arrays(cols, names=[*b.schema.names, "part", "row_at", "byte_at"])
            row, byte = row + len(sizes), int(ends[-1]) if len(sizes) else byte

    kinds = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes) + ", part int, row_at long, byte_at long"
    placed = materialize(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(running, kinds), name)
    totals = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("b")).orderBy("part").collect()
    offsets, n, b = [], 0, 0
    for t in totals:
        offsets.append((t["part"], n, b))
        n, b = n + t["n"], b + t["b"]
    # One row for each range partition: bounded by the number of partitions.
    small = F.broadcast(spark.createDataFrame(offsets, "part int, row_0 long, byte_0 long"))
    out = (placed.join(small, "part")
           .withColumn("row_at", F.col("row_at") + F.col("row_0")).withColumn("byte_at", F.col("byte_at") + F.col("byte_0"))
           .drop("part", "row_0", "byte_0"))
    return out, n, b


def byte_shards(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard and slot (0, 1, ... inside the shard) of every row.

    A row goes to the shard that holds the middle of its bytes, so a shard's size
    misses the target by one row's size at most.
    """
    raw = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = materialize(docs.select(
        F.col(id_col).alias("doc_id"), (F.length(raw) + F.lit(1)).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"), F.monotonically_increasing_id().alias("tie")), "shard-sizes")
    placed, _, total = byte_positions(rows, ["doc_id", "tie"], "size", "shard-positions")
    placed = placed.withColumn("shard", F.expr(
        f"cast(least({shards - 1}, ((2 * byte_at + size) * {shards}) div {2 * max(total, 1)}) as int)"))
    first = placed.groupBy("shard").agg(F.min("row_at").alias("row_0"))  # at most one row a shard
    return (placed.join(F.broadcast(first), "shard")
            .select("doc_id", "size", "text_crc32", "shard", (F.col("row_at") - F.col("row_0")).alias("slot")))
