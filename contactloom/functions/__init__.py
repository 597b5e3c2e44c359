"""Column functions: each takes and gives Columns, all of them JVM expressions."""
