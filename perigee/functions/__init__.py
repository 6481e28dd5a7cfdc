"""Column builders: each function takes and returns Spark columns."""
