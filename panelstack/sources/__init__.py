from panelstack.sources.fixtures import (
    hourly_readings, p1_hourly_panel, p2_daily_panel, p3_measure_panel, region_daily_panel, table,
)
from panelstack.sources.readers import (
    annotate_schema, build_hourly_payload, explode_hourly, read_dimension, read_observations,
    read_predictions,
)
from panelstack.sources.writers import latest_json, upsert_predictions, write_panel, write_report

__all__ = [
    "hourly_readings", "p1_hourly_panel", "p2_daily_panel", "p3_measure_panel", "region_daily_panel", "table",
    "annotate_schema", "build_hourly_payload", "explode_hourly", "read_dimension", "read_observations",
    "read_predictions", "latest_json", "upsert_predictions", "write_panel", "write_report",
]
