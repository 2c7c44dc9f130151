"""Continuous ingestion and running statistics."""
