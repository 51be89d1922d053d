"""Spark-native evaluation and curation analytics."""
