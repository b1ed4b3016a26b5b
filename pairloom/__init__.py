"""Spark-native engine for blocking two tables and for the data processing around it."""

__version__ = "0.1.0"
