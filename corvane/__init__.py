"""corvane: a Spark-first engine for event-sourced memory analytics and retrieval."""
