"""Whole plans: search, ingestion, evaluation."""
