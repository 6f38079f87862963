from panelstack.streaming.daily import daily_mean, stream_daily_mean, stream_dedup, stream_score

__all__ = ["daily_mean", "stream_daily_mean", "stream_dedup", "stream_score"]
