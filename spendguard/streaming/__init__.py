from spendguard.streaming.stream import score_stream, temporal_metrics_stream

__all__ = ["score_stream", "temporal_metrics_stream"]
