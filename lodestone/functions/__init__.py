"""Spark-native analytics."""
