"""Column functions: tokens, normalisation, fingerprints, line counts."""
