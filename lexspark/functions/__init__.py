"""Column expressions: text folding, court vocabulary, presentation."""
