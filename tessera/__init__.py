"""Spark jobs for ratings, text, search and models."""
