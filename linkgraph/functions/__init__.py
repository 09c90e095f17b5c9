"""Column functions: similarity kernels, names and ids, text."""
