"""Spark-native analytics over versioned, deduplicated collections of content."""
