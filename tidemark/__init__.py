"""Spark-first analytics for gauge readings, catchments, daily labels and text corpora."""
