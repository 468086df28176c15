"""Streaming entry points (the reference has no stream operators; this only
runs the batch search per micro-batch)."""
