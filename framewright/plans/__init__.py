"""Whole runs: which operators, in which order."""
