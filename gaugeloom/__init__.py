"""Agent-evaluation analytics as Spark jobs."""
