"""Registered queries: a Spark callable and, where SQL can say it, the DuckDB text of the same result."""
