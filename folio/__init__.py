"""A PySpark-native document retrieval engine."""
