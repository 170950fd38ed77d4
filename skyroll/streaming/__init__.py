"""Incremental runs with Structured Streaming."""

from skyroll.streaming.incremental import flight_stream, start_incremental_run

__all__ = ["flight_stream", "start_incremental_run"]
