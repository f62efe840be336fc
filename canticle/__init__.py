"""A PySpark-native engine for catalog resolution, text search, reports and timelines."""
