"""Column expressions: text, vectors, tokens."""
