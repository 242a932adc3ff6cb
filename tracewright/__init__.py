"""Spark-first analytics for program-debugging data and training-data pipelines."""
