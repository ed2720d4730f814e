"""Column-level building blocks: named aggregates and key helpers."""
