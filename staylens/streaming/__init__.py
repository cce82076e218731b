"""Streaming use of the row-local steps."""

from staylens.streaming.snapshots import stream_snapshots

__all__ = ["stream_snapshots"]
