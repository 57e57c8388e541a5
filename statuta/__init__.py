"""Spark-native analytics over a corpus of legal documents."""
