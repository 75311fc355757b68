"""Spark-native analytics over knowledge bases kept as linked pages."""
