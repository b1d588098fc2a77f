"""Spark-native corpus, retrieval, traffic and graph analytics."""
