"""Operators over document tables: writes, mapping inference, field statistics."""
