"""Lodestone: graph, numeric and training-data operators as plain Spark DataFrame jobs."""
