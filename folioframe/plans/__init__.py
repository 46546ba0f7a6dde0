"""Queries, plans and their registry."""
