"""City-planning and traffic analytics as Spark DataFrame jobs."""
