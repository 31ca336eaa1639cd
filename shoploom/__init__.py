"""Service-desk analytics and corpus preparation as Spark jobs."""
