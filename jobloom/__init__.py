"""A Spark-native engine for job-posting, board-registry and document-evidence tables."""
