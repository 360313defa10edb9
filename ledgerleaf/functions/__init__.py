"""Column expressions: everything per row, all Spark built-ins."""
