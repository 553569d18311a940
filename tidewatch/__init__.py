"""Spark-native vessel-traffic analytics."""
