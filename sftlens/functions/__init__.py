"""Column functions (native Spark expressions)."""
