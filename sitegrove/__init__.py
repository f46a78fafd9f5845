"""Sitegrove: a Spark-native engine for web asset graphs (assets, relations and what is derived from them)."""
