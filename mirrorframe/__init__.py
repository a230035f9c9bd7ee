"""Spark-native generation, scoring and ranking of synthetic tables."""
