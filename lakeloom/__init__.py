"""A PySpark-native analytics engine for publication-style corpora."""
