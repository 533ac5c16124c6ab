"""Spark-native retrieval, evidence audit and corpus processing."""
