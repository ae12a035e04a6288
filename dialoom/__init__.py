"""dialoom: a PySpark-native engine for building and curating interaction data."""

__version__ = "0.1.0"
