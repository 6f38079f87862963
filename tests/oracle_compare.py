"""Run registered Spark queries and their DuckDB oracle side by side (sf0.01 by default).

Usage: python tests/oracle_compare.py [name ...]
Prints one line per query: name, OK/FAIL, rows, details.
"""

from __future__ import annotations

import hashlib
import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def canon(pdf: pd.DataFrame) -> tuple[int, list[str], str]:
    cols = sorted(pdf.columns)
    pdf = pdf[cols]
    rows = []
    for rec in pdf.itertuples(index=False, name=None):
        vals = []
        for v in rec:
            if v is None or v is pd.NA or (isinstance(v, float) and v != v) or v is pd.NaT:
                vals.append("NULL")
            elif isinstance(v, float):
                vals.append(repr(round(v, 6)))
            elif hasattr(v, "isoformat"):
                vals.append(pd.Timestamp(v).isoformat())
            else:
                vals.append(str(v))
        rows.append("|".join(vals))
    rows.sort()
    return len(rows), cols, hashlib.sha256("\n".join(rows).encode()).hexdigest()[:16]


def main(names: list[str]) -> int:
    from __spark_entry__ import oracle_sql, queries
    from panelstack.session import get_spark

    sf_dir = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")
    if names and names[0] == "--plain":
        # Mimic a caller's plain session: default driver memory, default configs.
        from pyspark.sql import SparkSession
        names = names[1:]
        spark = (SparkSession.builder.master("local[*]").config("spark.sql.shuffle.partitions", "8")
                 .config("spark.ui.enabled", "false").getOrCreate())
    else:
        spark = get_spark("local[8]", 8)
    qs, sqls = queries(), oracle_sql()
    con = duck(sf_dir)
    bad = 0
    for name in names or sorted(qs):
        t0 = time.time()
        try:
            sdf = qs[name](spark, sf_dir).toPandas()
        except Exception as e:  # noqa: BLE001
            print(f"{name:28s} SPARK-ERROR {type(e).__name__}: {str(e)[:300]}")
            bad += 1
            continue
        ts = time.time() - t0
        if name not in sqls:
            print(f"{name:28s} ROWS-ONLY rows={len(sdf)} spark={ts:.1f}s")
            continue
        try:
            ddf = con.execute(sqls[name]).df()
        except Exception as e:  # noqa: BLE001
            print(f"{name:28s} SQL-ERROR {str(e)[:300]}")
            bad += 1
            continue
        a, b = canon(sdf), canon(ddf)
        ok = a == b
        bad += 0 if ok else 1
        print(f"{name:28s} {'OK  ' if ok else 'FAIL'} rows spark={a[0]} duck={b[0]} spark={ts:.1f}s"
              + ("" if ok else f" cols={a[1]} vs {b[1]}"))
        if not ok and a[1] == b[1] and a[0] == b[0]:
            cols = a[1]
            s2 = sdf[cols].sort_values(cols).reset_index(drop=True)
            d2 = ddf[cols].sort_values(cols).reset_index(drop=True)
            for c in cols:
                try:
                    diff = (s2[c].astype(str) != d2[c].astype(str))
                except Exception:  # noqa: BLE001
                    continue
                if diff.any():
                    i = diff.idxmax()
                    print(f"    col {c}: {int(diff.sum())} diffs, e.g. spark={s2[c][i]!r} duck={d2[c][i]!r}")
        elif not ok:
            print(f"    spark dtypes: {dict(sdf.dtypes.astype(str))}\n    duck dtypes: {dict(ddf.dtypes.astype(str))}")
    print(f"FAILURES: {bad}")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
