"""Column expressions: text, rule scans, keys, dates and scores."""
