"""Spark-native corpus curation and evaluation."""
