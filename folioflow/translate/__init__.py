"""Runs of a model."""
