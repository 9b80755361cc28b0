"""Retrieval over streams of queries."""
