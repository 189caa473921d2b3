"""Spark-native analytics for text knowledge bases."""
