"""Incremental topics over micro-batches, and event-time windows."""
