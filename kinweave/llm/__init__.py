"""Operators for large text and record collections."""
