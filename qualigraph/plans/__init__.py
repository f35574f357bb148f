"""Composed plans and the semantic registry."""
