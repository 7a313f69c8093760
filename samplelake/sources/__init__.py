"""Readers: attribute files, papers, task graphs, supplementary files, matrices, result pages."""
