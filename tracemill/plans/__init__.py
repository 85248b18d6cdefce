"""Longer jobs that chain the operators."""
