"""A PySpark-native point-in-time analytics engine."""
