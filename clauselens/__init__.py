"""Auditable document relevance on Spark."""
