"""Spark-native graph analytics."""
