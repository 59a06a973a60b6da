"""Community detection on large weighted graphs, expressed as Spark DataFrame operators."""
