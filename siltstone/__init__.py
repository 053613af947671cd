"""Spark-native retrieval and groundedness analytics."""
