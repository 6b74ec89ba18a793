"""Column expressions and plain-Python kernels."""
