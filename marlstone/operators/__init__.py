"""Operators: DataFrames in, DataFrames out, keyed by query_id, doc_id or unit_id."""
