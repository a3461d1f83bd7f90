"""Composed jobs built from operators and expression factories."""
