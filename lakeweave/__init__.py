"""Spark-native table discovery, pair scoring and training-data operators."""
