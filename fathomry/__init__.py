"""Spark-native retrieval analytics: ingest, index, search, evaluate, answer, learn from feedback."""

__version__ = "0.1.0"
