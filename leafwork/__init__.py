"""Document-corpus analytics as Spark jobs."""
