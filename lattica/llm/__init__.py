"""Operators for building training corpora: filtering, deduplication, scoring, packing, archives."""
