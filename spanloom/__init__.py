"""Spark-native analytics over time-aligned, multi-channel content."""
