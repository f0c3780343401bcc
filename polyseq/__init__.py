"""Spark-native analytics over symbol sequences."""
