"""Lodestack: a PySpark-native engine for knowledge retrieval over collections of text documents."""
