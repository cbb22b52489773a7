"""Scalar functions over columns: colours and geometry."""
