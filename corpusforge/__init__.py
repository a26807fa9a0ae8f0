"""Spark-native corpus analytics: retrieval, curation, graph and catalog operators."""
