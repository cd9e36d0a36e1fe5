"""Spark-native indexing, search and audit of collections of long documents."""
