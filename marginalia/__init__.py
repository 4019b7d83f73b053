"""Notes, activity logs and usage accounts analysed with Spark."""
