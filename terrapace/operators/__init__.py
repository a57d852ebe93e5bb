"""Relational operators and search kernels."""
