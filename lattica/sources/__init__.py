"""Generators, graph files, and graphs derived from tables."""
