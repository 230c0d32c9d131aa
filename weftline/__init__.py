"""Spark-native analytics for part libraries and long chains of part-level edits."""
