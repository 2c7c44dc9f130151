"""Columns: fields of documents and the scalar functions that requests and ingestion need."""
