"""Column expressions, string and graph kernels, special functions."""
