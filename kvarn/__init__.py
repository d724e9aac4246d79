"""Spark-native knowledge retrieval engine."""
