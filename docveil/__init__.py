"""docveil: document-privacy analytics as Spark DataFrame operators."""
