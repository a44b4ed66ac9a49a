"""Column functions: each takes and returns ``Column``, built from native expressions."""
