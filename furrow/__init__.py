"""Farm-event analytics written as PySpark DataFrame and Structured Streaming jobs."""
