"""Column-level functions: everything here takes and returns Spark Columns."""
