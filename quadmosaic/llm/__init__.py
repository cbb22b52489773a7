"""Operators for preparing language-model training text, as Spark jobs.

Nothing else in the library imports this subpackage.
"""
