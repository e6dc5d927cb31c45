"""A PySpark-native engine for typed column filtering, index lookups and vector search."""

__version__ = "0.1.0"
