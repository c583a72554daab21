"""Composed jobs and the catalogue of queries over the star-schema tables."""
