"""Column expressions over names, values and vectors."""
