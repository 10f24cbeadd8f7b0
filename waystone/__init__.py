"""Location and address analytics as Spark DataFrame jobs."""
