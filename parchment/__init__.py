"""Parchment: a Spark-native engine over page-description documents and text corpora."""
