"""Spark-native curation of large text corpora: every stage is a DataFrame -> DataFrame function."""
