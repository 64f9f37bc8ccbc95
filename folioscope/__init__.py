"""Spark-first analytics over knowledge bases of clipped web documents."""
