"""Column expressions on text and vectors."""
