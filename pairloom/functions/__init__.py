"""Column expressions: tokenizers, similarities, name normalisation, sparse vectors."""
