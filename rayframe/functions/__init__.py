"""Column expressions: vectors, and kernels from rays to matrix elements."""
