"""Streams: query logs rolled up as they arrive, and windowed counts of events."""
