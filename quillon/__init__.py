"""Quillon: a PySpark-native engine for a small dynamically typed collection language."""
