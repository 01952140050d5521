"""Product recommendation and review analytics as Spark DataFrame jobs."""
