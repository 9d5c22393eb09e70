"""scrivana: document-retrieval analytics as Spark DataFrame jobs."""
