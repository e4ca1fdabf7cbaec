"""Column expressions: normalisers and scores without I/O."""
