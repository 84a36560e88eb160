"""Column builders and schema look-ups."""
