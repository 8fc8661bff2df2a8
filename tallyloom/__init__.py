"""Spark-native differential verification and evidence analytics."""

__version__ = "0.1.0"
