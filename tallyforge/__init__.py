"""Spark-native analytics for worksheet and practice data."""
