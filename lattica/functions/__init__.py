"""Helpers over (id, value) metrics."""
