"""Hybrid search and retrieval analytics as Spark DataFrame plans."""
