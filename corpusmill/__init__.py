"""Spark-native engine for document corpora and the knowledge bases built from them."""
