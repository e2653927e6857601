"""Contact data and corpus operators as Spark DataFrame jobs."""
