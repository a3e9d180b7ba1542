"""Spark-native lineage analytics and data-processing engine."""

__version__ = "0.1.0"
