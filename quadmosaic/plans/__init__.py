"""Queries by name, over the tables of the test data."""
