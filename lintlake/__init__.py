"""Spark-native source-code security analytics."""

__version__ = "0.1.0"
