"""Column functions: normalization, keys, scores."""
