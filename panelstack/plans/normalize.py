"""Output normalisation shared by a Spark query and its oracle SQL.

Doubles are compared as floor(x*1e6 + 0.5137)/1e6 on both sides: panel means
often sit exactly on decimal ties, where ``round`` would flip on the last bit.
Integers are widened to BIGINT.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

OFFSET = 0.5137


def stable(df: DataFrame) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = (F.floor(c.cast("double") * F.lit(1e6) + F.lit(OFFSET)) / F.lit(1e6)).cast("double")
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def wrap_sql(inner: str, doubles: list[str] = (), ints: list[str] = ()) -> str:
    """Apply the same normalisation to an oracle query (DuckDB ``SELECT * REPLACE``)."""
    reps = [f'CAST(floor(CAST("{c}" AS DOUBLE) * 1e6 + {OFFSET}) / 1e6 AS DOUBLE) AS "{c}"' for c in doubles]
    reps += [f'CAST("{c}" AS BIGINT) AS "{c}"' for c in ints]
    if not reps:
        return f"SELECT * FROM (\n{inner}\n) q"
    return f"SELECT * REPLACE ({', '.join(reps)}) FROM (\n{inner}\n) q"
