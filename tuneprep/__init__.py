"""Spark-native preparation and measurement of fine-tuning data."""

__version__ = "0.1.0"
