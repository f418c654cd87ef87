"""Batch analytics over recorded video timelines, on Spark."""
