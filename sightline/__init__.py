"""Spark-native analytics for scan-event streams."""
