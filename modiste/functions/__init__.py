"""Column functions: prices, text, vectors and steer phrases."""
