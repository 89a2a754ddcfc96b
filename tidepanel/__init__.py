"""Panel and time-series analytics as plain Spark DataFrame jobs."""
