"""Column expressions: JSON, labels, scores, dates and texts."""
