"""SQL building blocks for the DuckDB oracle: the derived panels and window templates.

They mirror the Spark definitions in ``panelstack.sources.fixtures`` and the
operators; being plain SQL text they are independent of the Spark code path.
"""

from __future__ import annotations

P1 = ("p1 AS (SELECT event_type AS series_id, date_trunc('hour', ts) AS hour, avg(value) AS value "
      "FROM events GROUP BY 1, 2)")
P2 = ("p2 AS (SELECT o_orderpriority AS series_id, CAST(o_orderdate AS DATE) AS date, "
      "avg(o_totalprice) / 1000.0 AS value FROM orders GROUP BY 1, 2)")
P3 = ("p3 AS (SELECT l_returnflag AS series_id, CAST(l_shipdate AS DATE) AS date, avg(l_quantity) AS quantity, "
      "avg(l_extendedprice) AS extendedprice, avg(l_discount) AS discount, avg(l_tax) AS tax "
      "FROM lineitem GROUP BY 1, 2)")
DAILY = ("daily AS (SELECT event_type AS series_id, CAST(ts AS DATE) AS day, round(avg(value), 2) AS value "
         "FROM events GROUP BY 1, 2)")


def grid(src: str, name: str = "grid", cols: str = "value") -> str:
    sel = ", ".join(f"s.{c}" for c in cols.split(","))
    return (f"{name} AS (SELECT g.series_id, g.date, {sel} FROM (SELECT series_id, "
            f"CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS date FROM "
            f"(SELECT series_id, min(date) AS lo, max(date) AS hi FROM {src} GROUP BY 1)) g "
            f"LEFT JOIN {src} s ON s.series_id = g.series_id AND s.date = g.date)")


def interp(src: str, name: str, cols: list[str], method: str = "time", edges: str = "both",
           other: str = "") -> str:
    """Linear interpolation by elapsed days (``time``) or row position (``linear``)."""
    pos = ("CAST(row_number() OVER (PARTITION BY series_id ORDER BY date) AS DOUBLE)" if method == "linear"
           else "CAST(date - DATE '1970-01-01' AS DOUBLE)")
    wins = []
    outs = []
    for c in cols:
        wins.append(f"last_value({c} IGNORE NULLS) OVER wb AS pv_{c}, "
                    f"last_value(CASE WHEN {c} IS NOT NULL THEN pos END IGNORE NULLS) OVER wb AS pt_{c}, "
                    f"first_value({c} IGNORE NULLS) OVER wa AS nv_{c}, "
                    f"first_value(CASE WHEN {c} IS NOT NULL THEN pos END IGNORE NULLS) OVER wa AS nt_{c}")
        tail = f"WHEN pv_{c} IS NULL THEN nv_{c} ELSE pv_{c}" if edges == "both" else f"WHEN pv_{c} IS NOT NULL THEN pv_{c}"
        outs.append(f"CASE WHEN {c} IS NOT NULL THEN {c} WHEN pv_{c} IS NOT NULL AND nv_{c} IS NOT NULL THEN "
                    f"pv_{c} + (nv_{c} - pv_{c}) * (pos - pt_{c}) / (nt_{c} - pt_{c}) {tail} END AS {c}")
    extra = f", {other}" if other else ""
    return (f"{name} AS (SELECT series_id, date{extra}, {', '.join(outs)} FROM (SELECT *, {', '.join(wins)} FROM "
            f"(SELECT *, {pos} AS pos FROM {src}) "
            f"WINDOW wb AS (PARTITION BY series_id ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), "
            f"wa AS (PARTITION BY series_id ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)))")


# The standard daily index panel: P2 on a gap-free calendar grid, filled by time interpolation.
P2I = ",\n".join([P2, grid("p2"), interp("grid", "p2i", ["value"])])

W = "PARTITION BY series_id ORDER BY date"


def band_code(x: str) -> str:
    return (f"CASE WHEN {x} <= 50 THEN 0 WHEN {x} <= 100 THEN 1 WHEN {x} <= 150 THEN 2 WHEN {x} <= 200 THEN 3 "
            f"WHEN {x} <= 300 THEN 4 WHEN {x} IS NOT NULL THEN 5 END")


def band_label(x: str) -> str:
    return (f"CASE WHEN {x} <= 50 THEN 'Good' WHEN {x} <= 100 THEN 'Moderate' "
            f"WHEN {x} <= 150 THEN 'Unhealthy for Sensitive Groups' WHEN {x} <= 200 THEN 'Unhealthy' "
            f"WHEN {x} <= 300 THEN 'Very Unhealthy' WHEN {x} IS NOT NULL THEN 'Hazardous' END")


def aqi_class(x: str) -> str:
    return (f"CASE WHEN {x} > 0 AND {x} <= 50 THEN 0 WHEN {x} > 50 AND {x} <= 100 THEN 1 "
            f"WHEN {x} > 100 AND {x} <= 150 THEN 2 WHEN {x} > 150 AND {x} <= 200 THEN 3 "
            f"WHEN {x} > 200 AND {x} <= 300 THEN 4 WHEN {x} > 300 AND {x} <= 500 THEN 5 END")


BANDS = ("bands(band_code, band) AS (VALUES (0, 'Good'), (1, 'Moderate'), (2, 'Unhealthy for Sensitive Groups'), "
         "(3, 'Unhealthy'), (4, 'Very Unhealthy'), (5, 'Hazardous'))")


def clip(x: str, lo: float, hi: float) -> str:
    return f"CASE WHEN {x} IS NOT NULL AND NOT isnan({x}) THEN least(greatest({x}, {lo}), {hi}) END"
