"""Analytics over the artifacts of automated test generation, as Spark DataFrame operations."""
