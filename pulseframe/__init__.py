"""Spark-native analytics for sampled physiological signals."""

__version__ = "0.1.0"
