"""Query registry: name -> (Spark plan builder, oracle SQL).

Every builder takes ``(spark, sf_dir)``, reads the driver tables and returns a
lazy DataFrame; :func:`queries` applies the shared output normalisation.
Entries without SQL are checked rows-only (model fits, streaming).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from panelstack.plans.normalize import stable, wrap_sql


@dataclass
class Entry:
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None
    doubles: list[str] = field(default_factory=list)
    ints: list[str] = field(default_factory=list)


REGISTRY: dict[str, Entry] = {}


def register(name: str, sql: str | None = None, doubles: list[str] | str = (), ints: list[str] | str = ()):
    if isinstance(doubles, str):
        doubles = doubles.split()
    if isinstance(ints, str):
        ints = ints.split()

    def deco(fn):
        REGISTRY[name] = Entry(fn, sql, list(doubles), list(ints))
        return fn
    return deco


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return {name: (lambda spark, sf_dir, e=e: stable(e.build(spark, sf_dir))) for name, e in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return {name: wrap_sql(e.sql, e.doubles, e.ints) for name, e in REGISTRY.items() if e.sql}


def _load() -> None:
    # Importing the modules registers their queries.
    from panelstack.plans import q_arima, q_basic, q_model, q_series, q_stats, q_stream  # noqa: F401
