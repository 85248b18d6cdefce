"""Spark operators for the logs and corpora that surround AI systems."""
