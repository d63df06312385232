"""Loomstone: a Spark-native analytics engine for agent data."""

__version__ = "0.1.0"
