"""Rows to files."""
