"""Column expressions: casts, identities, time arithmetic, text extraction, hashing."""
