"""Column expressions built only from Spark's own functions."""
