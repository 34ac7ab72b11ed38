"""Spark-native analytics for ordered payment-authorization streams."""

__version__ = "0.1.0"
