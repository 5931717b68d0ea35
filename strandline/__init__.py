"""strandline: a PySpark-native engine for sequence, resistance and taxonomy analytics."""

__version__ = "0.1.0"
