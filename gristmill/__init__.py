"""Spark-first analytics library for news, event and document data."""
