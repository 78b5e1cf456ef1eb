"""lexiloom: a PySpark-native analytics engine for compositional lexicons."""

__version__ = "0.1.0"
