"""Spark-native operators for turning batches of documents into a curated, searchable item bank."""
