"""Column functions: analysis, similarities, expressions, vectors, geography, strings and dates."""
