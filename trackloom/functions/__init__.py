"""Column functions: text normalisation, parsing and similarity."""
