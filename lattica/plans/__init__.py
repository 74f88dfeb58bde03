"""Iterative and per-source plans, and the query registry."""
