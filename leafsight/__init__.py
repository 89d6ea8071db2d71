"""Spark-first document chunking, hybrid page search and retrieval evaluation."""
