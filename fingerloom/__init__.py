"""Spark-native analytics over collections of file fingerprints."""
