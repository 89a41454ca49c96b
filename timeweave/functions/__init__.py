"""Column functions; all are Spark expressions."""
