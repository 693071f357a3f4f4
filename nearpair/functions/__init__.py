"""Column functions: tokenizers, measures and the exact bounds derived from them."""
