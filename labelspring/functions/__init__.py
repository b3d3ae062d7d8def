"""Column expressions: keyed hashes, score rules, vector arithmetic."""
