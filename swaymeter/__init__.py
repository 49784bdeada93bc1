"""Narrative-risk analytics as Spark DataFrame operators."""
