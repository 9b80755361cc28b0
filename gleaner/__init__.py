"""Retrieval, ranking evaluation and corpus analytics on Spark."""
