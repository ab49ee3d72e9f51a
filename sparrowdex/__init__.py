"""Spark-native engine for document knowledge bases."""
