"""Column expressions: text, vectors and reproducible hashing."""
