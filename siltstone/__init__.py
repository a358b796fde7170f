"""Siltstone: Spark-first analytics over document corpora."""
