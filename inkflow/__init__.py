"""Spark-native preparation of text corpora and token sequences."""
