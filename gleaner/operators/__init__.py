"""Operators on DataFrames: retrieval, metrics, curves, strata, corpora and topics."""
