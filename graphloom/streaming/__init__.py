"""Projections as streams: the same pipes as in batch, with idempotent sinks."""
