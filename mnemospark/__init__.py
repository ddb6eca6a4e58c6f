"""Spark-native analytics over a conversational memory store."""
