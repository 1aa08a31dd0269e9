"""Spark-native analytics for long-format biomedical measurement data."""

__version__ = "0.1.0"
