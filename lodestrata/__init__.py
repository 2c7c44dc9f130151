"""Document-search analytics and data processing on PySpark."""
