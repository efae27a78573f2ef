"""Live forms of the monitors."""

from tallyforge.streaming.monitors import (
    split_late_rows,
    stream_files,
    stream_sessions,
    stream_spike_state,
    stream_window_alerts,
)

__all__ = ["split_late_rows", "stream_files", "stream_sessions", "stream_spike_state", "stream_window_alerts"]
