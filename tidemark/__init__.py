"""Spark-first product analytics and observability engine."""
