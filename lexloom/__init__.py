"""Spark-native engine for corpora of legal texts: index, search, extraction and content security."""
