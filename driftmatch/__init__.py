"""Fuzzy multi-pattern text matching on Spark."""
