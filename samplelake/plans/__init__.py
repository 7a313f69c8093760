"""Whole jobs: metadata rows, count matrices, workflow tools, record search."""
