"""seqloom: a PySpark-native analytics engine for fixed-length observation sequences."""
