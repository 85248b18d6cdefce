"""Operators for large text collections that become training data; nothing else in the library imports this package."""
