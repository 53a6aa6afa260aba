"""Spark-native processing of collected postings, pages, documents and event logs."""
