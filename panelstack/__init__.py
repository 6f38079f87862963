"""panelstack: panel time-series analytics expressed as Spark DataFrame plans.

Every operator takes a DataFrame plus the series key columns ``keys`` and the
time column ``t``; windows are always ``partitionBy(keys)`` so one code path
serves a single series or many thousands of them.
"""

from panelstack.session import get_spark, scratch_path

__all__ = ["get_spark", "scratch_path"]
