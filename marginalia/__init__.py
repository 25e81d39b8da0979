"""Spark-native analytics over a personal knowledge corpus."""
