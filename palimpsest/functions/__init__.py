"""Column functions: vectors, text identity, hashing, redaction, weights and dates."""
