"""Requests: their syntax tree, its parsers, and what may go wrong."""
