"""Column expressions: evidence codes, scalar clean-up, scores, vectors."""
