"""Speech-timeline analytics as Spark DataFrame, SQL and Structured Streaming jobs."""
