"""PySpark-native engine for chunked, hierarchical n-dimensional arrays."""
