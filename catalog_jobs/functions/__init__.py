"""Column functions: everything here is built from Spark's own functions, with no Python for each row."""
