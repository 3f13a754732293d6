"""Column expressions that Spark has no exact equivalent of, and text rendering."""
