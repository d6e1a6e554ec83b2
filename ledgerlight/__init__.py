"""Usage, cost and safety analytics over request logs, as Spark jobs."""
