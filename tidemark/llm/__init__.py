"""Operators of a training-data pipeline; queries are in tidemark.llm.queries."""
