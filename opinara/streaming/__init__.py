"""Scoring of review files as they arrive."""
