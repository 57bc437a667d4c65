"""Spark-native retrieval, grounding and corpus engine."""
