"""Calendar parts, cyclic encodings, flags, date shifts and local stamps."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def calendar_parts(df: DataFrame, t: str, prefix: str = "") -> DataFrame:
    """year, month, day, weekday (Monday=0) and day_of_year of a date column."""
    d = F.to_date(F.col(t))
    return df.withColumns({
        f"{prefix}year": F.year(d),
        f"{prefix}month": F.month(d),
        f"{prefix}day": F.dayofmonth(d),
        f"{prefix}weekday": F.weekday(d),
        f"{prefix}day_of_year": F.dayofyear(d),
    })


def cyclic_features(t: str) -> dict[str, Column]:
    """sin/cos of month/12, weekday/7 and day_of_year/365 (366 is not special-cased)."""
    d = F.to_date(F.col(t))
    parts = {"month": (F.month(d), 12), "weekday": (F.weekday(d), 7), "day_of_year": (F.dayofyear(d), 365)}
    out: dict[str, Column] = {}
    for name, (value, period) in parts.items():
        angle = F.lit(2 * math.pi) * value / F.lit(period)
        out[f"{name}_sin"] = F.sin(angle)
        out[f"{name}_cos"] = F.cos(angle)
    return out


# The dry season is December to April.
DRY_MONTHS = [12, 1, 2, 3, 4]


def flag_features(t: str, dry_months: list[int] | None = None) -> dict[str, Column]:
    """is_weekend (Sat/Sun) and is_dry_season as 0/1 ints."""
    d = F.to_date(F.col(t))
    months = dry_months or DRY_MONTHS
    return {
        "is_weekend": (F.weekday(d) >= 5).cast("int"),
        "is_dry_season": F.month(d).isin(months).cast("int"),
    }


def next_day(t, days: int = 1) -> Column:
    return F.date_add(F.to_date(_col(t)), days)


def local_stamp(ts, tz: str = "Asia/Ho_Chi_Minh", fmt: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """UTC timestamp -> wall-clock string in ``tz``."""
    return F.date_format(F.from_utc_timestamp(_col(ts), tz), fmt)


def minmax_normalise(c, lo: Column, hi: Column, eps: float = 1e-9) -> Column:
    """(x - min) / (max - min + eps)."""
    return (_col(c) - lo) / (hi - lo + F.lit(eps))


def percent_label(label, pct, digits: int = 2) -> Column:
    """'<label> (<pct>%)' with ``digits`` decimals; the value is rounded half-up first, so the
    printed digits do not depend on how a formatter treats binary ties."""
    scale = float(10 ** digits)
    rounded = F.floor(_col(pct) * F.lit(scale) + F.lit(0.5)) / F.lit(scale)
    return F.format_string(f"%s (%.{digits}f%%)", _col(label), rounded)
