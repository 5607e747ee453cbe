"""A PySpark-native engine for large collections of hash-set samples and their metadata."""
