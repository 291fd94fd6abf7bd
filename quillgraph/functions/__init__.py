"""Column functions: text, identifiers, JSON and vectors."""
