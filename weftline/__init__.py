"""Spark-native measurement engine for captured web pages and document corpora."""
