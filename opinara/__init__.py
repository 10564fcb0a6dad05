"""opinara: a PySpark-native analytics engine for large collections of user feedback."""

__version__ = "0.1.0"
