"""Column helpers: native Spark expressions, no Python UDFs."""
