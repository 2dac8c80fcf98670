"""Spark-native analytics for binary-outcome prediction markets."""
