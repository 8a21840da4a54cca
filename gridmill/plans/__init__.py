"""Queries on the gold tables and the full build."""
