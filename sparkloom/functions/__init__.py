"""Column expressions: text, answers, numbers, hashes."""
