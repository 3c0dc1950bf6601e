"""Spark-native curation and querying of a place catalog."""
