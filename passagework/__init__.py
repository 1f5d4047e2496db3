"""passagework: corpus building, vector retrieval and declarative table queries on Spark."""
