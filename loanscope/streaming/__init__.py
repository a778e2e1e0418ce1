"""Incremental (micro-batch) re-expression of the score-and-upsert step."""
