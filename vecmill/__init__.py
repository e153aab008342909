"""Dynamic inverted-file vector search and its quality reports as PySpark plans."""
