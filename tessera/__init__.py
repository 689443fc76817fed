"""Spark-native analytics for aerial scenes."""
