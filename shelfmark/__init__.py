"""Shelfmark: a Spark-native engine for searching catalogs of files and documents."""
