"""Column functions: geometry, normalisation, strings and dates."""
