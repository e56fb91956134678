"""Batch analytics for hierarchical, time-stamped operational data on Spark."""
