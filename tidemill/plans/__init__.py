"""Queries over the provided tables, with the same in SQL."""
