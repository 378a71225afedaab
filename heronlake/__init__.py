"""A PySpark-native analytics engine for multi-source coverage data."""
