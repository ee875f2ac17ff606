"""Reaction and web-research analytics as Spark DataFrame programs."""
