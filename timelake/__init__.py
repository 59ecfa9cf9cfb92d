"""A PySpark-native analytics library for media timelines."""
