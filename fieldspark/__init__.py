"""Gridded and time-indexed field analytics as Spark DataFrame plans."""
