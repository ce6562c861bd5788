"""Spark-native analytics over decision trials, with tools for large text corpora."""
