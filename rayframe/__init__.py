"""A PySpark-native engine for tomographic analytics; see README.md."""
