"""Structured Streaming: incremental landing of arriving sensor files."""

from qforge.streaming.landing import infer_stream_layout, sensor_stream, start_landing

__all__ = ["infer_stream_layout", "sensor_stream", "start_landing"]
