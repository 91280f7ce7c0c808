"""Larkspur: a PySpark-native engine for daily retail demand panels."""

__version__ = "0.1.0"
