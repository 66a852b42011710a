"""Transit punctuality analytics expressed as Spark DataFrame jobs."""
