"""Spark-native relational, trace and training-data analytics."""
