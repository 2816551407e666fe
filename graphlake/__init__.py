"""A PySpark-native engine for graph facts, search, coverage and incremental state."""
