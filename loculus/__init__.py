"""Spark-first analytics for molecule-resolved spatial tables."""
