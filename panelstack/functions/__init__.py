from panelstack.functions.bands import (
    BAND_COLORS, BAND_EDGES, BAND_LABELS, aqi_band, aqi_band_code, aqi_class, band_dim, clip, nan_to_null,
)
from panelstack.functions.calendar import (
    calendar_parts, cyclic_features, flag_features, local_stamp, minmax_normalise, next_day, percent_label,
)

__all__ = [
    "BAND_COLORS", "BAND_EDGES", "BAND_LABELS", "aqi_band", "aqi_band_code", "aqi_class", "band_dim",
    "clip", "nan_to_null", "calendar_parts", "cyclic_features", "flag_features", "local_stamp",
    "minmax_normalise", "next_day", "percent_label",
]
