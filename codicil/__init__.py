"""Spark-native analytics for large libraries of versioned documents."""
