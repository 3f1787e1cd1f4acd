"""Photo-library analytics as Spark DataFrame transforms."""
