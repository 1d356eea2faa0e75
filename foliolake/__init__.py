"""foliolake: document-corpus analytics as composable Spark DataFrame operators."""
