"""Labour-market analytics as Spark jobs."""
